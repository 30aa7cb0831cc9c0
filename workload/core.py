"""Mapping, pairing, locus and statistics queries on the derived releases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import annotation as A
from annodelta.operators import loci, origins, pairing, signature, statistics
from annodelta.session import cut_lineage
from workload.release import SIDES, feature_lists, listed_features, listed_releases, release, release_sql, releases, with_extents

REL = release_sql()

# --- signature mapping ---------------------------------------------------------------

SIG = REL + """,
t_sig AS (SELECT contig, gene_id, transcript_id, string_agg(type || ':' || CAST("end" - start + 1 AS VARCHAR), ';'
    ORDER BY CASE WHEN fwd THEN start ELSE -start END, ln, pk, sk, px, sub) AS sig FROM t_feat GROUP BY 1, 2, 3),
q_sig AS (SELECT contig, gene_id, transcript_id, string_agg(type || ':' || CAST("end" - start + 1 AS VARCHAR), ';'
    ORDER BY CASE WHEN fwd THEN start ELSE -start END, ln, pk, sk, px, sub) AS sig FROM q_feat GROUP BY 1, 2, 3),
cand AS (
  SELECT t.contig, t.gene_id AS tg, q.gene_id AS qg, t.transcript_id AS tt, q.transcript_id AS qt,
    row_number() OVER (PARTITION BY t.contig, t.gene_id, q.gene_id
      ORDER BY t.transcript_id <> q.transcript_id, t.transcript_id, q.transcript_id) AS rn
  FROM t_sig t JOIN q_sig q ON t.contig = q.contig AND t.sig = q.sig),
coding AS (
  SELECT c.*, a.gene_name AS tn, b.gene_name AS qn, a.start AS ts, a."end" AS te, b.start AS qs, b."end" AS qe
  FROM cand c JOIN t_gene a ON a.contig = c.contig AND a.gene_id = c.tg JOIN q_gene b ON b.contig = c.contig AND b.gene_id = c.qg
  WHERE rn = 1 AND (coalesce(a.gene_biotype = 'protein_coding' OR a.source = 'protein_coding', FALSE)
    OR coalesce(b.gene_biotype = 'protein_coding' OR b.source = 'protein_coding', FALSE))),
map AS (
  SELECT contig, qg AS "queryId", tg AS "targetId", qt AS "queryTranscriptId", tt AS "targetTranscriptId",
    CASE WHEN tg = qg THEN 'GENE_ID_MAPPING,' ELSE '' END || CASE WHEN tt = qt THEN 'TRANSCRIPT_ID_MAPPING,' ELSE '' END
    || CASE WHEN tn = qn THEN 'NAME_MAPPING,' ELSE '' END || 'STRUCTURE_BASED_MAPPING,DISTANCE:'
    || CAST(greatest(0, qs - te, ts - qe) AS VARCHAR) AS mapping_origins
  FROM coding)"""


def _signed_releases(spark: SparkSession, sf_dir: str) -> tuple[A.Annotation, A.Annotation, tuple[DataFrame, DataFrame]]:
    """Both releases and their signatures, from lines shuffled once; the genes' extents come from the signed transcripts."""
    signatures = signature.digests_of_lists(feature_lists(spark, sf_dir))
    target, query = (with_extents(spark, sf_dir, side, signed) for side, signed in zip(SIDES, signatures))
    return target, query, signatures


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene mapping in the layout of the mapping file."""
    target, query, signatures = _signed_releases(spark, sf_dir)
    return render_mapping(signature.map_genes(target, query, signatures=signatures))


def render_mapping(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "contig", F.col("query_gene_id").alias("queryId"), F.col("target_gene_id").alias("targetId"),
        F.col("query_transcript_id").alias("queryTranscriptId"), F.col("target_transcript_id").alias("targetTranscriptId"),
        signature.render_origins(F.col("origins"), F.col("distance")).alias("mapping_origins"),
    )


def signature_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene mapping by transcripts of similar structure."""
    target, query, signatures = _signed_releases(spark, sf_dir)
    structures = signature.structures_of_lists(signatures, listed_features(spark, sf_dir, by_gene=True))
    return render_mapping(signature.map_genes(target, query, cutoff=SIMILAR, signatures=signatures, structures=structures))


SIMILAR = 0.9
_LISTS = """
{p}_sig AS (SELECT contig, gene_id, transcript_id, list({{'t': type, 'n': "end" - start + 1}}
    ORDER BY CASE WHEN fwd THEN start ELSE -start END, ln, pk, sk, px, sub) AS sig FROM {p}_feat GROUP BY 1, 2, 3)"""
SIGNATURE_SIMILAR = REL + "," + _LISTS.format(p="t") + "," + _LISTS.format(p="q") + """,
near AS (
  SELECT contig, a, b FROM (SELECT DISTINCT contig, sig AS a FROM t_sig) JOIN (SELECT DISTINCT contig, sig AS b FROM q_sig) USING (contig)
  WHERE least(len(a), len(b)) >= 0.9 * greatest(len(a), len(b)) - 1e-9
    AND list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i].t = b[i].t
      THEN least(a[i].n, b[i].n) / greatest(a[i].n, b[i].n) ELSE 0 END)) / greatest(len(a), len(b)) >= 0.9 - 1e-9),
cand AS (
  SELECT t.contig, t.gene_id AS tg, q.gene_id AS qg, t.transcript_id AS tt, q.transcript_id AS qt,
    row_number() OVER (PARTITION BY t.contig, t.gene_id, q.gene_id
      ORDER BY t.transcript_id <> q.transcript_id, t.transcript_id, q.transcript_id) AS rn
  FROM t_sig t JOIN near n ON n.contig = t.contig AND n.a = t.sig JOIN q_sig q ON q.contig = n.contig AND q.sig = n.b),
""" + SIG[SIG.index("coding AS ("):] + "\nSELECT * FROM map"


def signature_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query, signatures = _signed_releases(spark, sf_dir)
    pairs = cut_lineage(signature.map_genes(target, query, signatures=signatures).select("contig", "target_gene_id", "query_gene_id"))
    return signature.unmapped_genes(target, pairs, "target").unionByName(
        signature.unmapped_genes(query, pairs, "query")
    )


SIGNATURE_UNMAPPED = SIG + """
SELECT g.contig, g.gene_id, coalesce(g.gene_name, '') AS name, 'TARGET' AS origin FROM t_gene g
WHERE g.gene_biotype IS NOT NULL AND (g.gene_biotype = 'protein_coding' OR g.source = 'protein_coding')
  AND NOT EXISTS (SELECT 1 FROM map m WHERE m.contig = g.contig AND m."targetId" = g.gene_id)
UNION ALL
SELECT g.contig, g.gene_id, coalesce(g.gene_name, ''), 'QUERY' FROM q_gene g
WHERE g.gene_biotype IS NOT NULL AND (g.gene_biotype = 'protein_coding' OR g.source = 'protein_coding')
  AND NOT EXISTS (SELECT 1 FROM map m WHERE m.contig = g.contig AND m."queryId" = g.gene_id)"""


def signature_allowed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    return render_mapping(signature.map_genes(target, query, signatures=signature.digests_of_lists(feature_lists(spark, sf_dir), ["CDS"])))


def _transcript_matches(spark: SparkSession, sf_dir: str):
    target, query, signatures = _signed_releases(spark, sf_dir)
    pairs = cut_lineage(signature.map_genes(target, query, signatures=signatures))
    return target, query, pairs, signature.map_transcripts(pairs, *signatures)


def transcript_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_mapping(_transcript_matches(spark, sf_dir)[3])


TRANSCRIPT_MATCHES = SIG + """,
tmap AS (
  SELECT m.contig, m."queryId", m."targetId", q.transcript_id AS "queryTranscriptId", t.transcript_id AS "targetTranscriptId",
    CASE WHEN m."targetId" = m."queryId" THEN 'GENE_ID_MAPPING,' ELSE '' END
    || CASE WHEN contains(m.mapping_origins, 'NAME_MAPPING') THEN 'NAME_MAPPING,' ELSE '' END || 'STRUCTURE_BASED_MAPPING,'
    || CASE WHEN t.transcript_id = q.transcript_id THEN 'TRANSCRIPT_ID_MAPPING,' ELSE '' END
    || regexp_extract(m.mapping_origins, 'DISTANCE:.*$') AS mapping_origins
  FROM map m JOIN t_sig t ON t.contig = m.contig AND t.gene_id = m."targetId"
  JOIN q_sig q ON q.contig = m.contig AND q.gene_id = m."queryId" AND q.sig = t.sig)"""


def transcript_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query, pairs, matches = _transcript_matches(spark, sf_dir)
    matches = cut_lineage(matches.select("contig", "target_transcript_id", "query_transcript_id"))
    return signature.unmapped_transcripts(pairs, target.transcripts, matches, "target").unionByName(
        signature.unmapped_transcripts(pairs, query.transcripts, matches, "query")
    )


TRANSCRIPT_UNMAPPED = TRANSCRIPT_MATCHES + """
SELECT x.contig, x.transcript_id, coalesce(x.transcript_name, '') AS name, 'TARGET' AS origin FROM t_tx x
WHERE EXISTS (SELECT 1 FROM map m WHERE m.contig = x.contig AND m."targetId" = x.gene_id)
  AND NOT EXISTS (SELECT 1 FROM tmap m WHERE m.contig = x.contig AND m."targetTranscriptId" = x.transcript_id)
UNION ALL
SELECT x.contig, x.transcript_id, coalesce(x.transcript_name, ''), 'QUERY' FROM q_tx x
WHERE EXISTS (SELECT 1 FROM map m WHERE m.contig = x.contig AND m."queryId" = x.gene_id)
  AND NOT EXISTS (SELECT 1 FROM tmap m WHERE m.contig = x.contig AND m."queryTranscriptId" = x.transcript_id)"""


def mapping_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.filter_by_origins(
        mapping_table(spark, sf_dir), ["GENE_ID_MAPPING", "OVERLAPPING", "STRUCTURE_BASED_MAPPING"], require_all=True
    )


def mapping_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.filter_by_origins(mapping_table(spark, sf_dir), ["NAME_MAPPING", "DISTANCE"], require_all=False)


MAPPING_FILTER_ALL = SIG + """
SELECT * FROM map WHERE contains(mapping_origins, 'GENE_ID_MAPPING') AND mapping_origins LIKE '%DISTANCE:0'"""
MAPPING_FILTER_ANY = SIG + """
SELECT * FROM map WHERE contains(mapping_origins, 'NAME_MAPPING') OR mapping_origins NOT LIKE '%DISTANCE:0'"""


def mapping_rows_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    parsed = origins.parse_mapping_rows(mapping_table(spark, sf_dir))
    return origins.resolve_mapping(parsed, target.genes, query.genes).withColumn("origins", F.array_join("origins", "|"))


MAPPING_ROWS_PARSED = SIG + """
SELECT contig, "targetId" AS target_gene_id, "queryId" AS query_gene_id, "targetTranscriptId" AS target_transcript_id,
  "queryTranscriptId" AS query_transcript_id,
  array_to_string(list_filter(string_split(mapping_origins, ','), lambda x: NOT contains(x, ':') AND x <> 'TRANSCRIPT_ID_MAPPING'), '|') AS origins,
  CAST(regexp_extract(mapping_origins, 'DISTANCE:(-?[0-9]+)', 1) AS BIGINT) AS distance
FROM map"""


def gene_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of equally named genes of the two releases, across contigs too."""
    target, query = releases(spark, sf_dir)
    t = target.genes.where("start is not null").select(
        "gene_name", F.col("contig").alias("t_contig"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    q = query.genes.where("start is not null").select(
        "gene_name", F.col("contig").alias("q_contig"), F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    return t.join(q, "gene_name").select("gene_name", "t_contig", "q_contig", signature.gene_distance().alias("distance"))


GENE_DISTANCES = REL + """
SELECT t.gene_name, t.contig AS t_contig, q.contig AS q_contig,
  CASE WHEN t.contig <> q.contig THEN -1 ELSE greatest(0, q.start - t."end", t.start - q."end") END AS distance
FROM t_gene t JOIN q_gene q ON t.gene_name = q.gene_name WHERE t.start IS NOT NULL AND q.start IS NOT NULL"""

# --- id and rank pairing ---------------------------------------------------------------


def gene_id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    columns = ["contig", "gene_id", "start", "end", "fwd"]
    return pairing.pair_by_id(target.genes.select(columns), query.genes.select(columns), ["contig", "gene_id"])


GENE_ID_PAIRS = REL + """
SELECT coalesce(t.contig, q.contig) AS contig, coalesce(t.gene_id, q.gene_id) AS gene_id, t.start AS t_start, t."end" AS t_end, t.fwd AS t_fwd,
  q.start AS q_start, q."end" AS q_end, q.fwd AS q_fwd,
  CASE WHEN t.gene_id IS NULL THEN 'missing_in_target' WHEN q.gene_id IS NULL THEN 'missing_in_query' ELSE 'both' END AS side_state
FROM t_gene t FULL OUTER JOIN q_gene q ON t.contig = q.contig AND t.gene_id = q.gene_id"""


def _transcripts_of_gene_pairs(target: A.Annotation, query: A.Annotation, genes: DataFrame) -> DataFrame:
    columns = ["contig", "gene_id", "transcript_id", "start", "end", "fwd", *(c for c in target.transcripts.columns if c == A.PART)]
    return pairing.transcripts_of_gene_pairs(genes, target.transcripts.select(columns), query.transcripts.select(columns))


def transcript_id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    return pairing.exact_gene_difference(_transcripts_of_gene_pairs(target, query, gene_id_pairs(spark, sf_dir)))


TRANSCRIPT_ID_PAIRS = REL + """,
bg AS (SELECT contig, gene_id FROM t_gene SEMI JOIN q_gene USING (contig, gene_id))
SELECT contig, gene_id, transcript_id,
  t.start AS t_start, t."end" AS t_end, t.fwd AS t_fwd, q.start AS q_start, q."end" AS q_end, q.fwd AS q_fwd,
  CASE WHEN t.source IS NULL THEN 'missing_in_target' WHEN q.source IS NULL THEN 'missing_in_query' ELSE 'both' END AS side_state,
  (t."end" - t.start) IS DISTINCT FROM (q."end" - q.start) AS length_changed, t.fwd IS DISTINCT FROM q.fwd AS strand_changed,
  t.start IS DISTINCT FROM q.start AS start_changed, t."end" IS DISTINCT FROM q."end" AS stop_changed
FROM (SELECT x.* FROM t_tx x SEMI JOIN bg USING (contig, gene_id)) t
FULL OUTER JOIN (SELECT x.* FROM q_tx x SEMI JOIN bg USING (contig, gene_id)) q USING (contig, gene_id, transcript_id)"""


def rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    return pairing.pair_by_rank(target.features, query.features)


RANKED = REL + """,
t_rank AS (SELECT contig, transcript_id, type, start, "end", fwd,
  row_number() OVER (PARTITION BY contig, transcript_id, type ORDER BY start, "end", ln, pk, sk, px, sub) AS rank FROM t_feat),
q_rank AS (SELECT contig, transcript_id, type, start, "end", fwd,
  row_number() OVER (PARTITION BY contig, transcript_id, type ORDER BY start, "end", ln, pk, sk, px, sub) AS rank FROM q_feat)"""
RANK_PAIRS = RANKED + """
SELECT contig, transcript_id, type, rank, t.start AS t_start, t."end" AS t_end, t.fwd AS t_fwd, q.start AS q_start, q."end" AS q_end, q.fwd AS q_fwd,
  CASE WHEN t.start IS NULL THEN 'missing_in_target' WHEN q.start IS NULL THEN 'missing_in_query' ELSE 'both' END AS side_state
FROM t_rank t FULL OUTER JOIN q_rank q USING (contig, transcript_id, type, rank)"""


def old_style_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = listed_releases(spark, sf_dir, introns=False)
    genes = gene_id_pairs(spark, sf_dir)
    transcripts = _transcripts_of_gene_pairs(target, query, genes)
    regions = pairing.old_style_region_pairs(target.features, query.features, transcripts)
    return pairing.old_style_differences(genes, transcripts, regions)


OLD_STYLE = RANKED + """,
gp AS (SELECT contig, gene_id, t.contig IS NULL AS no_t, q.contig IS NULL AS no_q,
    t.start AS ts, t."end" AS te, q.start AS qs, q."end" AS qe, t.fwd AS tf, q.fwd AS qf
  FROM t_gene t FULL OUTER JOIN q_gene q USING (contig, gene_id)),
bg AS (SELECT * FROM gp WHERE NOT no_t AND NOT no_q),
tp AS (SELECT contig, gene_id, transcript_id AS tx, t.contig IS NULL AS no_t, q.contig IS NULL AS no_q,
    t.start AS ts, t."end" AS te, q.start AS qs, q."end" AS qe
  FROM (SELECT x.* FROM t_tx x SEMI JOIN bg USING (contig, gene_id)) t
  FULL OUTER JOIN (SELECT x.* FROM q_tx x SEMI JOIN bg USING (contig, gene_id)) q USING (contig, gene_id, transcript_id)),
bt AS (SELECT *, (te - ts) IS DISTINCT FROM (qe - qs) AS longer FROM tp WHERE NOT no_t AND NOT no_q),
rp AS (SELECT contig, p.gene_id, p.tx, r.type, r.rank, r.n_t, r.n_q, r.ts, r.te, r.qs, r.qe
  FROM (SELECT contig, transcript_id, type, rank, t.start AS ts, t."end" AS te, q.start AS qs, q."end" AS qe,
      count(t.start) OVER (PARTITION BY contig, transcript_id, type) AS n_t, count(q.start) OVER (PARTITION BY contig, transcript_id, type) AS n_q
    FROM t_rank t FULL OUTER JOIN q_rank q USING (contig, transcript_id, type, rank)) r
  JOIN bt p USING (contig) WHERE p.tx = r.transcript_id),
found(contig, gene_id, category, difference, loud) AS (
  SELECT contig, gene_id, 'gene', unnest(['length', 'seq']), TRUE FROM bg WHERE (te - ts) IS DISTINCT FROM (qe - qs)
  UNION ALL SELECT contig, gene_id, 'gene', 'strand', TRUE FROM bg WHERE tf IS DISTINCT FROM qf
  UNION ALL SELECT contig, gene_id, 'gene', 'start', FALSE FROM bg WHERE ts IS DISTINCT FROM qs
  UNION ALL SELECT contig, gene_id, 'gene', 'stop', FALSE FROM bg WHERE te IS DISTINCT FROM qe
  UNION ALL SELECT contig, gene_id, 'transcript', 'missingInFile1_' || tx, TRUE FROM tp WHERE no_t
  UNION ALL SELECT contig, gene_id, 'transcript', 'missingInFile2_' || tx, TRUE FROM tp WHERE no_q
  UNION ALL SELECT contig, gene_id, 'transcript', unnest(['length_', 'seq_']) || tx, TRUE FROM bt WHERE longer
  UNION ALL SELECT contig, gene_id, 'transcript', 'start_' || tx, FALSE FROM bt WHERE ts IS DISTINCT FROM qs
  UNION ALL SELECT contig, gene_id, 'transcript', 'stop_' || tx, FALSE FROM bt WHERE te IS DISTINCT FROM qe
  UNION ALL SELECT DISTINCT contig, gene_id, 'feature', 'missingInTranscript1_' || tx || '_' || type, TRUE FROM rp WHERE n_t = 0
  UNION ALL SELECT DISTINCT contig, gene_id, 'feature', 'missingInTranscript2_' || tx || '_' || type, TRUE FROM rp WHERE n_q = 0
  UNION ALL SELECT contig, gene_id, 'feature', 'missingFeatureEntryFile1_' || tx || '_' || type, FALSE FROM rp WHERE rank > n_t AND n_t > 0
  UNION ALL SELECT contig, gene_id, 'feature', 'missingFeatureEntryFile2_' || tx || '_' || type, FALSE FROM rp WHERE rank > n_q AND n_q > 0
  UNION ALL SELECT contig, gene_id, 'feature', unnest(['length_', 'seq_']) || tx || '_' || type, TRUE FROM rp WHERE te - ts <> qe - qs
  UNION ALL SELECT contig, gene_id, 'feature', 'position_' || tx || '_' || type, FALSE FROM rp WHERE ts <> qs OR te <> qe),
differ AS (SELECT DISTINCT contig, gene_id FROM found WHERE loud)
SELECT f.gene_id, f.category, f.difference FROM found f SEMI JOIN differ USING (contig, gene_id)
UNION ALL SELECT gene_id, 'gene', CASE WHEN no_t THEN 'missingInFile1' ELSE 'missingInFile2' END FROM gp WHERE no_t OR no_q
UNION ALL SELECT gene_id, '', '' FROM bg ANTI JOIN differ USING (contig, gene_id)"""

# --- loci ------------------------------------------------------------------------------

STRANDED = ["contig", "fwd"]


def _located(annotation: A.Annotation) -> DataFrame:
    return annotation.transcripts.where("start is not null").select("contig", "fwd", "transcript_id", "start", "end")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    return loci.overlapping_pairs(_located(target), _located(query), STRANDED)


OVERLAP_PAIRS = REL + """
SELECT t.contig, t.fwd, t.transcript_id AS t_transcript_id, t.start AS t_start, t."end" AS t_end,
  q.transcript_id AS q_transcript_id, q.start AS q_start, q."end" AS q_end
FROM t_tx t JOIN q_tx q ON t.contig = q.contig AND t.fwd = q.fwd AND t.start <= q."end" AND q.start <= t."end" """


def overlap_counts_unstranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap partners per target gene, strand ignored."""
    target, query = releases(spark, sf_dir)
    columns = ["contig", "gene_id", "start", "end"]
    t, q = (x.genes.where("start is not null").select(columns) for x in (target, query))
    return loci.overlapping_pairs(t, q, ["contig"]).groupBy("contig", "t_gene_id").agg(
        F.count(F.lit(1)).alias("partners"),
        F.sum(F.least("t_end", "q_end") - F.greatest("t_start", "q_start") + 1).alias("shared_bases"),
    )


OVERLAP_COUNTS = REL + """
SELECT t.contig, t.gene_id AS t_gene_id, count(*) AS partners,
  CAST(sum(least(t."end", q."end") - greatest(t.start, q.start) + 1) AS BIGINT) AS shared_bases
FROM t_gene t JOIN q_gene q ON t.contig = q.contig AND t.start <= q."end" AND q.start <= t."end" GROUP BY 1, 2"""


def exact_coordinate_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    keys = ["contig", "start", "end"]
    t = target.genes.where("start is not null").select(*keys, F.col("gene_id").alias("target_gene_id"))
    q = query.genes.where("start is not null").select(*keys, F.col("gene_id").alias("query_gene_id"))
    return t.join(q, keys)


EXACT_COORDINATE_GENES = REL + """
SELECT t.contig, t.start, t."end", t.gene_id AS target_gene_id, q.gene_id AS query_gene_id
FROM t_gene t JOIN q_gene q ON t.contig = q.contig AND t.start = q.start AND t."end" = q."end" """


def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    t, q = loci.assign_loci(_located(target), _located(query), STRANDED)
    columns = ["contig", "fwd", "locus", "transcript_id"]
    return t.select(*columns, F.lit("TARGET").alias("side")).unionByName(q.select(*columns, F.lit("QUERY").alias("side")))


COMPONENTS = """,
node AS (SELECT contig, fwd, 'TARGET' AS side, id, start, "end" FROM t_node UNION ALL SELECT contig, fwd, 'QUERY', id, start, "end" FROM q_node),
edge AS (SELECT t.contig, t.fwd, t.id AS t, q.id AS q FROM t_node t JOIN q_node q
  ON t.contig = q.contig AND t.fwd = q.fwd AND t.start <= q."end" AND q.start <= t."end"),
link AS (SELECT contig, fwd, 'TARGET' AS s1, t AS n1, 'QUERY' AS s2, q AS n2 FROM edge
  UNION ALL SELECT contig, fwd, 'QUERY', q, 'TARGET', t FROM edge),
reach AS (
  SELECT DISTINCT contig, fwd, s1 AS rs, n1 AS rn, s1 AS s, n1 AS n FROM link
  UNION SELECT r.contig, r.fwd, r.rs, r.rn, l.s2, l.n2 FROM reach r
    JOIN link l ON l.contig = r.contig AND l.fwd = r.fwd AND l.s1 = r.s AND l.n1 = r.n),
comp AS (SELECT r.contig, r.fwd, r.rs AS side, r.rn AS id, min(n.start) AS locus FROM reach r
  JOIN node n ON n.contig = r.contig AND n.fwd = r.fwd AND n.side = r.s AND n.id = r.n GROUP BY ALL)"""
OVERLAP_COMPONENTS = REL + """,
t_node AS (SELECT contig, fwd, transcript_id AS id, start, "end" FROM t_tx WHERE start IS NOT NULL),
q_node AS (SELECT contig, fwd, transcript_id AS id, start, "end" FROM q_tx WHERE start IS NOT NULL)""" + COMPONENTS + """
SELECT contig, fwd, locus, id AS transcript_id, side FROM comp"""


def clique_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    return loci.clique_statistics(loci.gene_states(target.genes, query.genes))


GENE_COMPONENTS = REL + """,
t_node AS (SELECT contig, fwd, gene_id AS id, start, "end" FROM t_gene WHERE start IS NOT NULL),
q_node AS (SELECT contig, fwd, gene_id AS id, start, "end" FROM q_gene WHERE start IS NOT NULL)""" + COMPONENTS + """,
exact AS (SELECT DISTINCT a.contig, a.id FROM comp a JOIN comp b
  ON a.contig = b.contig AND a.fwd = b.fwd AND a.locus = b.locus AND a.id = b.id AND a.side = 'TARGET' AND b.side = 'QUERY'),
state AS (
  SELECT g.contig, g.gene_id, g.side, CASE WHEN c.id IS NULL THEN 'NO_CLUSTER' WHEN e.id IS NOT NULL THEN 'EXACT' ELSE 'IN_CLUSTER_NO_EXACT' END AS state
  FROM (SELECT contig, gene_id, 'TARGET' AS side FROM t_gene UNION ALL SELECT contig, gene_id, 'QUERY' FROM q_gene) g
  LEFT JOIN comp c ON c.contig = g.contig AND c.id = g.gene_id AND c.side = g.side
  LEFT JOIN exact e ON e.contig = g.contig AND e.id = g.gene_id)"""
CLIQUE_STATS = GENE_COMPONENTS + """,
per AS (
  SELECT contig, count(*) FILTER (side = 'TARGET') AS target_genes, count(*) FILTER (side = 'QUERY') AS query_genes,
    (SELECT count(*) FROM (SELECT DISTINCT fwd, locus FROM comp c WHERE c.contig = state.contig)) AS clusters,
    count(*) FILTER (side = 'TARGET' AND state = 'EXACT') AS exact_matches,
    count(*) FILTER (side = 'TARGET' AND state = 'NO_CLUSTER') AS unmatched_target,
    count(*) FILTER (side = 'QUERY' AND state = 'NO_CLUSTER') AS unmatched_query,
    count(*) FILTER (side = 'TARGET' AND state = 'IN_CLUSTER_NO_EXACT') AS in_cluster_no_exact_target,
    count(*) FILTER (side = 'QUERY' AND state = 'IN_CLUSTER_NO_EXACT') AS in_cluster_no_exact_query
  FROM state GROUP BY contig)
SELECT * FROM per UNION ALL
SELECT 'TOTAL', CAST(sum(target_genes) AS BIGINT), CAST(sum(query_genes) AS BIGINT), CAST(sum(clusters) AS BIGINT), CAST(sum(exact_matches) AS BIGINT),
  CAST(sum(unmatched_target) AS BIGINT), CAST(sum(unmatched_query) AS BIGINT), CAST(sum(in_cluster_no_exact_target) AS BIGINT),
  CAST(sum(in_cluster_no_exact_query) AS BIGINT) FROM per"""


def clique_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    states = loci.gene_states(target.genes, query.genes)
    return states.where(F.col("state") != "EXACT").select("contig", "side", "state", "gene_id")


CLIQUE_UNMATCHED = GENE_COMPONENTS + "\nSELECT contig, side, state, gene_id FROM state WHERE state <> 'EXACT'"

# --- statistics and synthesis -------------------------------------------------------------


def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.global_counts(A.with_introns(release(spark, sf_dir, "target")))


INTRONS = REL + """,
t_next AS (SELECT contig, gene_id, transcript_id, fwd, "end", lead(start) OVER (PARTITION BY contig, transcript_id
    ORDER BY start, "end", ln, pk, sk, px, sub) AS nxt FROM t_feat WHERE type = 'exon'),
t_intron AS (SELECT contig, gene_id, transcript_id, 'intron' AS type, "end" + 1 AS start, nxt - 1 AS "end", fwd FROM t_next WHERE nxt > "end" + 1),
t_all AS (SELECT contig, transcript_id, type, start, "end" FROM t_feat UNION ALL SELECT contig, transcript_id, type, start, "end" FROM t_intron)"""
STATS_COUNTS = INTRONS + "".join(
    f"\nUNION ALL SELECT '{t}', count(*) FROM t_all WHERE type = '{t}'" for t in statistics.COUNTED_TYPES
).replace("\nUNION ALL", "\nSELECT 'genes' AS name, count(*) AS count FROM t_gene UNION ALL SELECT 'transcripts', count(*) FROM t_tx\nUNION ALL", 1)


def stats_biotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = release(spark, sf_dir, "target")
    genes = statistics.biotype_histogram(target.genes, "gene_biotype").withColumn("kind", F.lit("gene"))
    return genes.unionByName(
        statistics.biotype_histogram(target.transcripts, "transcript_biotype").withColumn("kind", F.lit("transcript"))
    )


STATS_BIOTYPES = REL + """
SELECT coalesce(gene_biotype, source) AS biotype, count(*) AS count, 'gene' AS kind FROM t_gene GROUP BY 1
UNION ALL SELECT coalesce(transcript_biotype, source), count(*), 'transcript' FROM t_tx GROUP BY 1"""


def stats_transcripts_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.transcripts_per_gene(release(spark, sf_dir, "target"))


STATS_TRANSCRIPTS_PER_GENE = REL + """
SELECT g.contig, g.gene_id, count(x.transcript_id) AS n FROM t_gene g LEFT JOIN t_tx x ON x.contig = g.contig AND x.gene_id = g.gene_id GROUP BY 1, 2"""


def stats_regions_per_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.regions_per_transcript(A.with_introns(release(spark, sf_dir, "target")))


STATS_REGIONS = INTRONS + """
SELECT x.contig, x.transcript_id, count(*) FILTER (f.type = 'exon') AS n_exon, count(*) FILTER (f.type = 'intron') AS n_intron
FROM t_tx x LEFT JOIN t_all f ON f.contig = x.contig AND f.transcript_id = x.transcript_id GROUP BY 1, 2"""


def stats_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.lengths(release(spark, sf_dir, "target"), introns=True)


STATS_LENGTHS = INTRONS + """
SELECT 'gene' AS kind, "end" - start + 1 AS length FROM t_gene WHERE start IS NOT NULL
UNION ALL SELECT 'transcript', "end" - start + 1 FROM t_tx WHERE start IS NOT NULL
UNION ALL SELECT type, "end" - start + 1 FROM t_all WHERE type IN ('exon', 'intron', 'CDS', 'five_prime_utr', 'three_prime_utr')"""


def intron_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.synthesize_introns(release(spark, sf_dir, "target").features).drop("ord")


INTRON_SYNTHESIS = INTRONS + "\nSELECT * FROM t_intron"


def gene_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = release(spark, sf_dir, "target")
    named = target.transcripts.withColumns({"gene_name": F.lit(None).cast("string"), "gene_biotype": F.col("transcript_biotype")})
    return A.synthesize_genes(named)


GENE_SYNTHESIS = REL + """
SELECT contig, gene_id, CAST(NULL AS VARCHAR) AS gene_name, min(transcript_biotype) AS gene_biotype, min(source) AS source,
  min(start) AS start, max("end") AS "end", bool_and(fwd) AS fwd FROM t_tx GROUP BY 1, 2"""


def fill_missing_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank one end of the transcripts on the reverse strand, then fill it from the children."""
    target = release(spark, sf_dir, "target")
    blanked = target.transcripts.withColumn("start", F.when(F.col("fwd"), F.col("start")))
    return A.fill_coordinates(blanked, target.features).select("contig", "transcript_id", "start", "end")


FILL_MISSING = REL + '\nSELECT contig, transcript_id, start, "end" FROM t_tx'

# --- lifted releases ------------------------------------------------------------------------


def lifted_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    columns = ["contig", "gene_id", "start", "end"]
    return pairing.lifted_pairs(query.genes.select(columns), target.genes.select(columns)).where("moved").select("contig", "gene_id")


LIFTED_POSITION = REL + """
SELECT contig, gene_id FROM t_gene t JOIN q_gene q USING (contig, gene_id) WHERE t.start <> q.start OR t."end" <> q."end" """


def lifted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query release taken as the lifted one; genes of equal place and other name differ in content."""
    target, query = releases(spark, sf_dir)
    lifted = query.genes.where(F.col("start").isNotNull())
    content = pairing.lifted_pairs(lifted, target.genes).where(
        ~F.col("moved") & ~F.col("t_gene_biotype").eqNullSafe(F.col("q_gene_biotype"))
    ).select("contig", "gene_id")
    return pairing.lifted_statistics(query.genes, target.genes, lifted, content)


LIFTED_STATS = REL + """,
per AS (
  SELECT contig, CAST(sum(query_genes) AS BIGINT) AS query_genes, CAST(sum(target_genes) AS BIGINT) AS target_genes,
    CAST(sum(lifted) AS BIGINT) AS lifted_query_genes, CAST(sum(normal) AS BIGINT) AS normal_pairs, CAST(sum(lp) AS BIGINT) AS lifted_pairs,
    CAST(sum(pos) AS BIGINT) AS differ_by_position, CAST(sum(seq) AS BIGINT) AS differ_by_sequence
  FROM (
    SELECT contig, 1 AS query_genes, 0 AS target_genes, CASE WHEN start IS NOT NULL THEN 1 ELSE 0 END AS lifted, 0 AS normal, 0 AS lp, 0 AS pos, 0 AS seq FROM q_gene
    UNION ALL SELECT contig, 0, 1, 0, 0, 0, 0, 0 FROM t_gene
    UNION ALL SELECT t.contig, 0, 0, 0, 1, CASE WHEN q.start IS NOT NULL THEN 1 ELSE 0 END,
      CASE WHEN coalesce(t.start <> q.start OR t."end" <> q."end", FALSE) THEN 1 ELSE 0 END,
      CASE WHEN q.start IS NOT NULL AND NOT coalesce(t.start <> q.start OR t."end" <> q."end", FALSE)
        AND t.gene_biotype IS DISTINCT FROM q.gene_biotype THEN 1 ELSE 0 END
      FROM t_gene t JOIN q_gene q ON t.contig = q.contig AND t.gene_id = q.gene_id) GROUP BY 1)
SELECT * FROM per UNION ALL SELECT 'TOTAL', CAST(sum(query_genes) AS BIGINT), CAST(sum(target_genes) AS BIGINT), CAST(sum(lifted_query_genes) AS BIGINT),
  CAST(sum(normal_pairs) AS BIGINT), CAST(sum(lifted_pairs) AS BIGINT), CAST(sum(differ_by_position) AS BIGINT), CAST(sum(differ_by_sequence) AS BIGINT) FROM per"""

QUERIES = {
    "signature_gene_mapping": (mapping_table, SIG + "\nSELECT * FROM map"),
    "signature_gene_mapping_cds_only": (signature_allowed_types, SIG.replace("FROM t_feat GROUP BY 1, 2, 3", "FROM t_feat WHERE type = 'CDS' GROUP BY 1, 2, 3")
                                        .replace("FROM q_feat GROUP BY 1, 2, 3", "FROM q_feat WHERE type = 'CDS' GROUP BY 1, 2, 3")
                                        + "\nSELECT * FROM map"),
    "signature_gene_mapping_similar": (signature_similar, SIGNATURE_SIMILAR),
    "signature_unmapped": (signature_unmapped, SIGNATURE_UNMAPPED),
    "transcript_mapping": (transcript_mapping, TRANSCRIPT_MATCHES + "\nSELECT * FROM tmap"),
    "transcript_unmapped": (transcript_unmapped, TRANSCRIPT_UNMAPPED),
    "mapping_filter_all": (mapping_filter_all, MAPPING_FILTER_ALL),
    "mapping_filter_any": (mapping_filter_any, MAPPING_FILTER_ANY),
    "mapping_rows_parsed": (mapping_rows_parsed, MAPPING_ROWS_PARSED),
    "gene_distance": (gene_distances, GENE_DISTANCES),
    "full_outer_genes": (gene_id_pairs, GENE_ID_PAIRS),
    "full_outer_transcripts": (transcript_id_pairs, TRANSCRIPT_ID_PAIRS),
    "rank_zip_regions": (rank_pairs, RANK_PAIRS),
    "id_join_diff": (old_style_differences, OLD_STYLE),
    "overlap_join": (overlap_pairs, OVERLAP_PAIRS),
    "overlap_join_unstranded": (overlap_counts_unstranded, OVERLAP_COUNTS),
    "overlap_exact_coordinates": (exact_coordinate_genes, EXACT_COORDINATE_GENES),
    "overlap_components": (overlap_components, OVERLAP_COMPONENTS),
    "clique_stats": (clique_stats, CLIQUE_STATS),
    "clique_unmatched": (clique_unmatched, CLIQUE_UNMATCHED),
    "stats_counts": (stats_counts, STATS_COUNTS),
    "stats_biotypes": (stats_biotypes, STATS_BIOTYPES),
    "stats_transcripts_per_gene": (stats_transcripts_per_gene, STATS_TRANSCRIPTS_PER_GENE),
    "stats_regions_per_transcript": (stats_regions_per_transcript, STATS_REGIONS),
    "stats_lengths": (stats_lengths, STATS_LENGTHS),
    "intron_synthesis": (intron_synthesis, INTRON_SYNTHESIS),
    "gene_synthesis": (gene_synthesis, GENE_SYNTHESIS),
    "fill_missing_coords": (fill_missing_coordinates, FILL_MISSING),
    "lifted_diff_position": (lifted_position, LIFTED_POSITION),
    "lifted_stats": (lifted_stats, LIFTED_STATS),
}
