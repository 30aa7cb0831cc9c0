"""Sequence, scoring, matching, difference and log queries, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import annotation as A
from annodelta.annotation import with_introns
from annodelta.compat import Compat
from annodelta.config import Comparison
from annodelta.constants import CODON_TABLE
from annodelta.functions import scoring, sequence, text
from annodelta.operators import (
    comparators, difference, fallback, genome, history, loci, matching, pairing, profile, regions,
)
from annodelta.session import cut_lineage
from workload.core import REL, RANKED, STRANDED, _located
from workload.matching_sql import MATCH, PAIRS
from workload.release import listed_releases, releases, spread, table

# --- genome text taken from the documents ------------------------------------------------

WINDOW = 120
GENOME_CHUNK = 1000


def genomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunked genomes with one contig per document; long documents are revised in the query genome."""
    docs = table(spark, sf_dir, "documents")
    bases = F.regexp_replace("text", "[^ACGTacgt]", "N")
    docs = spread(docs.select("doc_id", "text", "n_chars"), "doc_id")
    contig = F.col("doc_id").cast("string").alias("contig")
    revised = F.when(F.col("n_chars") > 3000, F.translate(bases, "a", "g")).otherwise(bases)
    return tuple(
        genome.chunk_sequences(docs.select(contig, s.alias("seq")), GENOME_CHUNK) for s in (bases, revised)
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into neighbouring spans that cover the whole text."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("contig"), F.length("text").cast("long").alias("n")
    ).where("n > 0")
    return docs.select(
        "contig", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {WINDOW})")).alias("window")
    ).select(
        "contig", "window", (F.col("window") * WINDOW + 1).alias("start"),
        F.least((F.col("window") + 1) * WINDOW, F.col("n")).alias("end"),
    )


WINDOWS_SQL = f"""
WITH doc AS (SELECT CAST(doc_id AS VARCHAR) AS contig, length(text) AS n, regexp_replace(text, '[^ACGTacgt]', 'N', 'g') AS t_seq,
    CASE WHEN n_chars > 3000 THEN translate(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'), 'a', 'g')
      ELSE regexp_replace(text, '[^ACGTacgt]', 'N', 'g') END AS q_seq
  FROM documents WHERE length(text) > 0),
win AS (SELECT contig, w AS "window", w * {WINDOW} + 1 AS start, least((w + 1) * {WINDOW}, n) AS "end",
    substring(t_seq, w * {WINDOW} + 1, least({WINDOW}, n - w * {WINDOW})) AS t_sequence,
    substring(q_seq, w * {WINDOW} + 1, least({WINDOW}, n - w * {WINDOW})) AS q_sequence
  FROM (SELECT *, unnest(range(0, (n - 1) // {WINDOW} + 1)) AS w FROM doc))"""


def fetch_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.fetch_spans(windows(spark, sf_dir), genomes(spark, sf_dir)[0], ["window"], GENOME_CHUNK)


def _window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows(spark, sf_dir).select(
        "contig", "window", F.col("start").alias("t_start"), F.col("end").alias("t_end"),
        F.col("start").alias("q_start"), F.col("end").alias("q_end"),
    )
    return genome.compare_spans(spans, *genomes(spark, sf_dir), ["window"], GENOME_CHUNK)


def validate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_pairs(spark, sf_dir).select(
        "contig", "window", F.col("t_sequence").eqNullSafe(F.col("q_sequence")).alias("same")
    )


def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_sequences(spark, sf_dir).select(
        "contig", "window", sequence.reverse_complement(F.col("sequence")).alias("kept_case"),
        sequence.reverse_complement_upper(F.col("sequence")).alias("upper_only"),
    )


REVERSE_COMPLEMENTS = WINDOWS_SQL + """
SELECT contig, "window", translate(reverse(t_sequence), 'ACGTacgt', 'TGCAtgca') AS kept_case,
  translate(regexp_replace(reverse(t_sequence), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') AS upper_only FROM win"""

_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODON_TABLE.items()) + "}"


def _protein_sql(column: str, codons: str) -> str:
    return (f"list_transform(range(0, {codons}), lambda i: coalesce({_CODONS}"
            f"[upper(substring({column}, CAST(i * 3 + 1 AS BIGINT), 3))], 'X'))")


def codon_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = F.upper("sequence")
    return fetch_sequences(spark, sf_dir).select("contig", "window", sequence.translate_codons(upper).alias("protein"))


CODON_TRANSLATE = WINDOWS_SQL + f"""
SELECT contig, "window", array_to_string({_protein_sql('t_sequence', 'length(t_sequence) // 3')}, '') AS protein FROM win"""


def same_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein comparison of every window of the two genomes, once skipping the last codon and once not."""
    t, q = F.col("t"), F.col("q")
    upper = _window_pairs(spark, sf_dir).select("contig", "window", F.upper("t_sequence").alias("t"), F.upper("q_sequence").alias("q"))
    verdicts = F.col("verdicts")
    return upper.withColumn("verdicts", sequence.protein_verdicts(t, q)).select(
        "contig", "window", sequence.protein_changed(t, q, verdicts=verdicts).alias("changed"),
        sequence.protein_changed(t, q, skip_last_codon=False, verdicts=verdicts).alias("changed_full"),
    )


def _changed_sql(codons: str) -> str:
    t, q = _protein_sql("t_sequence", codons), _protein_sql("q_sequence", codons)
    verdict = f"array_to_string(list_transform(list_zip({t}, {q}), lambda x: CASE WHEN x[1] <> x[2] THEN 'd' WHEN x[1] = '*' THEN 's' ELSE '=' END), '')"
    return f"regexp_matches({verdict}, '^=*d')"


SAME_PROTEIN = WINDOWS_SQL + f"""
SELECT contig, "window", {_changed_sql('(length(t_sequence) - 1) // 3')} AS changed, {_changed_sql('length(t_sequence) // 3')} AS changed_full FROM win"""


def coding_sequence_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as genes, sources as contigs: pairs of documents with equal text in the two genomes."""
    from annodelta.operators.signature import map_genes_by_coding_sequence

    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("contig"), F.col("doc_id").cast("string").alias("gene_id"),
        F.col("doc_id").cast("string").alias("transcript_id"), F.col("text").alias("cds"), "n_chars",
    )
    revised = F.when(F.col("n_chars") > 3000, F.translate("cds", "a", "g")).otherwise(F.col("cds"))
    return map_genes_by_coding_sequence(docs, docs.withColumn("cds", revised))


CODING_SEQUENCE_MAPPING = """
WITH t AS (SELECT source AS contig, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS cds FROM documents),
q AS (SELECT source AS contig, CAST(doc_id AS VARCHAR) AS id, coalesce(CASE WHEN n_chars > 3000 THEN translate(text, 'a', 'g') ELSE text END, '') AS cds FROM documents)
SELECT t.contig, t.id AS target_gene_id, q.id AS query_gene_id, t.id AS target_transcript_id, q.id AS query_transcript_id
FROM t JOIN q ON t.contig = q.contig AND t.cds = q.cds"""


def alignment_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against their revised versions: edits in English, heavy ones elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")  # dealt by the digests of the texts
    edited = F.when(F.col("lang") == "en", F.regexp_replace("text", " by ", " "))
    for lang, letters in (("de", "e"), ("fr", "éê")):
        edited = edited.when(F.col("lang") == lang, F.translate("text", letters, ""))
    queries = docs.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("id"), edited.otherwise(F.col("text")).alias("sequence"))
    targets = docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("sequence"))
    return fallback.map_by_alignment(targets, queries)


# --- similarity of models ------------------------------------------------------------------


def _id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same_id_pairs(*releases(spark, sf_dir), ["contig", "transcript_id", "start", "end", "fwd"])


def _same_id_pairs(target: A.Annotation, query: A.Annotation, columns: list[str]) -> DataFrame:
    return pairing.pair_by_id(
        target.transcripts.where("start is not null").select(columns),
        query.transcripts.where("start is not null").select(columns), ["contig", "transcript_id"], "inner",
    )


def endpoint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_pairs(spark, sf_dir).select(
        "contig", "transcript_id", F.round(scoring.end_score(), 6).alias("ends"),
        F.round(scoring.midpoint_score(), 6).alias("midpoint"),
    )


ENDPOINT_SCORE = REL + """
SELECT t.contig, t.transcript_id,
  round(0.4 * exp(-abs(CASE WHEN t.fwd THEN t.start ELSE t."end" END - CASE WHEN q.fwd THEN q.start ELSE q."end" END) / 150.0)
    + 0.6 * exp(-abs(CASE WHEN t.fwd THEN t."end" ELSE t.start END - CASE WHEN q.fwd THEN q."end" ELSE q.start END) / 250.0), 6) AS ends,
  round(CASE WHEN t.fwd = q.fwd THEN exp(-abs((t.start + t."end") // 2 - (q.start + q."end") // 2) / 10000.0) ELSE 0 END, 6) AS midpoint
FROM t_tx t JOIN q_tx q ON t.contig = q.contig AND t.transcript_id = q.transcript_id WHERE t.start IS NOT NULL AND q.start IS NOT NULL"""


def _model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = (with_introns(x) for x in releases(spark, sf_dir))
    pairs = _id_pairs(spark, sf_dir).select(
        "contig", F.col("transcript_id").alias("target_transcript_id"), F.col("transcript_id").alias("query_transcript_id")
    )
    return matching.compare_models(pairs, target.features, query.features)


def model_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_pairs(spark, sf_dir).select(
        "contig", F.col("target_transcript_id").alias("transcript_id"), F.round("jaccard", 6).alias("jaccard")
    )


def _painted(p: str) -> str:
    return f"""
{p}_nxt AS (SELECT contig, transcript_id, "end", lead(start) OVER w AS nxt, ln, pk, sk, px, sub FROM {p}_feat WHERE type = 'exon'
  WINDOW w AS (PARTITION BY contig, transcript_id ORDER BY start, "end", ln, pk, sk, px, sub)),
{p}_child AS (
  SELECT contig, transcript_id, type, start, "end", row_number() OVER (PARTITION BY contig, transcript_id ORDER BY syn, ln, pk, sk, px, sub) AS pos
  FROM (SELECT contig, transcript_id, type, start, "end", 0 AS syn, ln, pk, sk, px, sub FROM {p}_feat
    UNION ALL SELECT contig, transcript_id, 'intron', "end" + 1, nxt - 1, 1, ln, pk, sk, px, sub FROM {p}_nxt WHERE nxt > "end" + 1))"""


MODEL_JACCARD = REL + "," + _painted("t") + "," + _painted("q") + """,
both_child AS (SELECT t.* FROM t_child t SEMI JOIN q_child q USING (contig, transcript_id)),
both_query AS (SELECT q.* FROM q_child q SEMI JOIN t_child t USING (contig, transcript_id)),
cuts AS (SELECT contig, transcript_id, start AS c FROM both_child UNION SELECT contig, transcript_id, "end" + 1 FROM both_child
  UNION SELECT contig, transcript_id, start FROM both_query UNION SELECT contig, transcript_id, "end" + 1 FROM both_query),
cells AS (SELECT contig, transcript_id, c AS a, lead(c) OVER (PARTITION BY contig, transcript_id ORDER BY c) - 1 AS b FROM cuts),
t_paint AS (SELECT x.contig, x.transcript_id, x.a, arg_min(f.type, f.pos) AS type FROM cells x JOIN both_child f
  ON f.contig = x.contig AND f.transcript_id = x.transcript_id AND f.start <= x.a AND f."end" >= x.b GROUP BY ALL),
q_paint AS (SELECT x.contig, x.transcript_id, x.a, arg_min(f.type, f.pos) AS type FROM cells x JOIN both_query f
  ON f.contig = x.contig AND f.transcript_id = x.transcript_id AND f.start <= x.a AND f."end" >= x.b GROUP BY ALL),
counted AS (
  SELECT x.contig, x.transcript_id,
    count(*) FILTER (t.type <> 'exon' AND q.type <> 'exon' AND t.type = q.type) AS shared,
    count(*) FILTER (t.type <> 'exon') + count(*) FILTER (q.type <> 'exon') AS total
  FROM cells x LEFT JOIN t_paint t USING (contig, transcript_id, a) LEFT JOIN q_paint q USING (contig, transcript_id, a) GROUP BY 1, 2)
SELECT contig, transcript_id, round(CASE WHEN total - shared > 0 THEN shared / (total - shared) ELSE 0 END, 6) AS jaccard FROM counted"""


def chain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_pairs(spark, sf_dir).select(
        "contig", F.col("target_transcript_id").alias("transcript_id"), F.round("chain", 6).alias("chain")
    )


CHAIN_SIMILARITY = REL + """,
tc AS (SELECT contig, transcript_id, list("end" - start + 1 ORDER BY start, ln, pk, sk, px) AS a FROM t_feat WHERE type = 'exon' GROUP BY 1, 2),
qc AS (SELECT contig, transcript_id, list("end" - start + 1 ORDER BY start, ln, pk, sk, px) AS b FROM q_feat WHERE type = 'exon' GROUP BY 1, 2),
dp AS (
  SELECT t.contig, t.transcript_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 2 * j) AS line
  FROM tc t JOIN qc q ON t.contig = q.contig AND t.transcript_id = q.transcript_id
  UNION ALL
  SELECT contig, transcript_id, a, b, i + 1,
    list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc,
      least(acc[j] + 2, line[j + 1] + 2, line[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)), [CAST(2 * (i + 1) AS BIGINT)])
  FROM dp WHERE i < len(a))
SELECT contig, transcript_id, round(1 - line[len(b) + 1] / greatest(len(a), len(b)), 6) AS chain FROM dp WHERE i = len(a)"""


def reciprocal_best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits of both sides among overlapping transcripts, by rounded end score."""
    target, query = releases(spark, sf_dir)
    pairs = loci.overlapping_pairs(_located(target), _located(query), STRANDED)
    scores = pairs.withColumns({"t_fwd": F.col("fwd"), "q_fwd": F.col("fwd")}).select(
        "contig", F.col("t_transcript_id").alias("target_transcript_id"), F.col("q_transcript_id").alias("query_transcript_id"),
        F.round(scoring.end_score(), 6).alias("score"),
    )
    return matching.reciprocal_best_hits(scores)


RECIPROCAL = REL + """,
pair AS (
  SELECT t.contig, t.transcript_id AS target_transcript_id, q.transcript_id AS query_transcript_id,
    round(0.4 * exp(-abs(CASE WHEN t.fwd THEN t.start - q.start ELSE t."end" - q."end" END) / 150.0)
      + 0.6 * exp(-abs(CASE WHEN t.fwd THEN t."end" - q."end" ELSE t.start - q.start END) / 250.0), 6) AS score
  FROM t_tx t JOIN q_tx q ON t.contig = q.contig AND t.fwd = q.fwd AND t.start <= q."end" AND q.start <= t."end"),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, target_transcript_id ORDER BY score DESC, query_transcript_id) AS rt,
    row_number() OVER (PARTITION BY contig, query_transcript_id ORDER BY score DESC, target_transcript_id) AS rq FROM pair)
SELECT contig, target_transcript_id, query_transcript_id, score FROM ranked WHERE rt = 1 AND rq = 1"""

# --- matching and differences -----------------------------------------------------------------


def _matches(spark: SparkSession, sf_dir: str):
    target, query = listed_releases(spark, sf_dir)
    found = matching.match_transcripts(
        target.transcripts.where("start is not null"), query.transcripts.where("start is not null"),
        target.features, query.features,
    )
    return target, query, cut_lineage(found)


def bipartite_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)[2]


BIPARTITE_MATCHING = REL + "," + _painted("t") + "," + _painted("q") + MATCH + """
SELECT contig, fwd, locus, target_transcript_id, query_transcript_id, score FROM match"""


def reciprocal_model_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of a locus that are each other's most similar model."""
    target, query = listed_releases(spark, sf_dir)
    return matching.reciprocal_model_hits(
        target.transcripts.where("start is not null"), query.transcripts.where("start is not null"), target.features, query.features)


RECIPROCAL_MODELS = REL + "," + _painted("t") + "," + _painted("q") + PAIRS + """,
hit AS (SELECT contig, fwd, locus, t, q, CAST(floor((0.5::DOUBLE * (CASE WHEN whole > 0 THEN shared / whole ELSE 0 END)
    + 0.5::DOUBLE * chain) * 1000000 + 0.5001) AS BIGINT) AS units FROM pair JOIN chained USING (a, b)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, fwd, locus, t ORDER BY units DESC, q) AS rt,
    row_number() OVER (PARTITION BY contig, fwd, locus, q ORDER BY units DESC, t) AS rq FROM hit)
SELECT contig, fwd, locus, t AS target_transcript_id, q AS query_transcript_id, units / 1000000 AS score FROM ranked
WHERE rt = 1 AND rq = 1"""


def exon_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All region pairs of the transcripts known to both releases."""
    target, query = listed_releases(spark, sf_dir)
    pairs = _same_id_pairs(target, query, ["contig", "transcript_id", A.PART]).select(
        "contig", F.col("transcript_id").alias("target_transcript_id"), F.col("transcript_id").alias("query_transcript_id"),
        f"t_{A.PART}", f"q_{A.PART}")
    return regions.pair_regions(cut_lineage(pairs), target.features, query.features)


SETTINGS = Comparison(thresholds={"start": 5.0}, impacts={"start": "LOW", "CDS": "HIGH", "stop_codon": "LOW"})


def analysis_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full difference table of the matched transcripts."""
    target, query, found = _matches(spark, sf_dir)
    pairs = difference.transcript_pairs(found, target, query, SETTINGS)
    return difference.difference_table(pairs, target, query, SETTINGS)


def descriptor_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method descriptors built from the line items, as a reader sees them."""
    letters = "substr('ZBCSIJFD', cast(l_quantity as int) % 8 + 1, 1)"
    raw = F.expr(f"""concat('(', repeat('[', cast(l_linenumber % 3 as int)), {letters}, case when l_linenumber > 3 then
        concat('L', 'org/', l_returnflag, '/', l_linestatus, ';') else '' end, ')', repeat('[', cast(l_linenumber % 2 as int)), case when l_linenumber > 5
        then 'Lorg/Sample;' else 'V' end)""")
    shown = table(spark, sf_dir, "lineitem").select(profile.readable_descriptor(raw).alias("descriptor"))
    return shown.groupBy("descriptor").agg(F.count("*").alias("n"))


DESCRIPTOR_PRINT = """
SELECT descriptor, count(*) AS n FROM (SELECT '(' ||
    ['boolean', 'byte', 'char', 'short', 'int', 'long', 'float', 'double'][CAST(l_quantity AS INTEGER) % 8 + 1] || repeat('[]', l_linenumber % 3)
    || CASE WHEN l_linenumber > 3 THEN ', org.' || l_returnflag || '.' || l_linestatus ELSE '' END || ')'
    || CASE WHEN l_linenumber > 5 THEN 'org.Sample' ELSE 'void' END || repeat('[]', l_linenumber % 2) AS descriptor FROM lineitem)
GROUP BY descriptor"""


def _ranked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, query = releases(spark, sf_dir)
    ranked = pairing.pair_by_rank(target.features, query.features)
    shared = _id_pairs(spark, sf_dir).select("contig", "transcript_id")
    return ranked.join(shared, ["contig", "transcript_id"], "left_semi").withColumn("absent", F.lit(None).cast("string"))


def comparator_diff_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region differences of rank-paired regions in long form, with keys and impacts."""
    flagged = difference.region_differences(_ranked_regions(spark, sf_dir), SETTINGS)
    return flagged.withColumn("d", F.explode("found")).select(
        "contig", "transcript_id", "type", "rank", "d.order_key", "d.difference", "d.impact"
    )


_IMPACT = """CASE WHEN {kind} = 'CDS' THEN 'HIGH' WHEN {kind} = 'stop_codon' THEN 'LOW' ELSE {other} END"""
COMPARATOR_DIFF = RANKED + f""",
pair AS (SELECT contig, transcript_id, type, rank, t.start AS ts, t."end" AS te, q.start AS qs, q."end" AS qe
  FROM t_rank t FULL OUTER JOIN q_rank q USING (contig, transcript_id, type, rank)),
known AS (SELECT p.* FROM pair p SEMI JOIN t_feat t USING (contig, transcript_id) SEMI JOIN q_feat q USING (contig, transcript_id))
SELECT contig, transcript_id, type, rank, 300 AS order_key, 'length' AS difference, {_IMPACT.format(kind='type', other="'MODERATE'")} AS impact
  FROM known WHERE te - ts <> qe - qs
UNION ALL SELECT contig, transcript_id, type, rank, 310, 'start', {_IMPACT.format(kind='type', other="'LOW'")} FROM known WHERE abs(ts - qs) > 5
UNION ALL SELECT contig, transcript_id, type, rank, 320, 'stop', {_IMPACT.format(kind='type', other="'MODERATE'")} FROM known WHERE te <> qe
UNION ALL SELECT contig, transcript_id, type, rank, 350, 'missingFeatureEntryFileInTarget', {_IMPACT.format(kind='type', other="'MODERATE'")} FROM known WHERE ts IS NULL
UNION ALL SELECT contig, transcript_id, type, rank, 360, 'missingFeatureEntryFileInQuery', {_IMPACT.format(kind='type', other="'MODERATE'")} FROM known WHERE qs IS NULL"""


def impact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of region differences per impact and difference."""
    return comparator_diff_long(spark, sf_dir).groupBy("impact", "difference").agg(F.count(F.lit(1)).alias("n"))


def transcript_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript comparators on id pairs, one flag each, thresholds of 10 positions."""
    target, query = releases(spark, sf_dir)
    columns = ["contig", "transcript_id", "start", "end", "fwd", A.biotype("transcript_biotype").alias("biotype")]
    pairs = pairing.pair_by_id(
        target.transcripts.where("start is not null").select(*columns),
        query.transcripts.where("start is not null").select(*columns), ["contig", "transcript_id"], "inner")
    flags = [c.changed(10.0, Compat()).alias(c.name) for c in comparators.of_grain("transcript")]
    return pairs.select("contig", "transcript_id", *flags)


TRANSCRIPT_COMPARATORS = REL + """
SELECT t.contig, t.transcript_id, abs(t.start - q.start) > 10 AS transcript_start, abs(t."end" - q."end") > 10 AS transcript_stop,
  abs((t."end" - t.start) - (q."end" - q.start)) > 10 AS transcript_length, t.fwd <> q.fwd AS transcript_strand,
  coalesce(t.transcript_biotype, t.source) <> coalesce(q.transcript_biotype, q.source) AS transcript_biotype
FROM t_tx t JOIN q_tx q ON t.contig = q.contig AND t.transcript_id = q.transcript_id WHERE t.start IS NOT NULL AND q.start IS NOT NULL"""


def gene_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene comparators on genes paired by name, contigs included."""
    target, query = releases(spark, sf_dir)
    columns = ["gene_name", "contig", "start", "end", "fwd"]
    pairs = pairing.pair_by_id(
        target.genes.where("start is not null and gene_name is not null").select(columns),
        query.genes.where("start is not null and gene_name is not null").select(columns), ["gene_name"], "inner")
    flags = [c.changed(100.0, Compat()).alias(c.name) for c in comparators.of_grain("gene")]
    return pairs.select("gene_name", *flags)


GENE_COMPARATORS = REL + """
SELECT t.gene_name, abs(t.start - q.start) > 100 AS gene_start, abs(t."end" - q."end") > 100 AS gene_stop, t.fwd <> q.fwd AS gene_strand,
  abs((t."end" - t.start) - (q."end" - q.start)) > 100 AS gene_length, t.contig <> q.contig AS gene_contig
FROM t_gene t JOIN q_gene q ON t.gene_name = q.gene_name WHERE t.start IS NOT NULL AND q.start IS NOT NULL"""

# --- text formats and logs -----------------------------------------------------------------


def attribute_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute columns written from events, with a repeated and an unquoted key, parsed again."""
    event = F.concat(
        F.lit('gene_id "'), F.col("user_id").cast("string"), F.lit('"; gene_name "'), "event_type",
        F.lit('"; tag "a'), F.col("event_id").cast("string"), F.lit('"; level '), F.get_json_object("props", "$.k"),
        F.lit('; tag "b"; note "";'),
    )
    parsed = table(spark, sf_dir, "events").select("event_id", text.parse_attributes(event).alias("m"), event.alias("line"))
    first = [text.first_attribute(F.col("m"), k).alias(k) for k in ("gene_id", "gene_name", "tag", "level", "note", "absent")]
    return parsed.select(
        "event_id", *first, F.array_join(F.element_at("m", "tag"), "|").alias("tags"), F.size("m").alias("keys"),
        text.attribute_value(F.col("line"), "level").alias("level_direct"),
    )


ATTRIBUTE_PARSE = """
SELECT event_id, CAST(user_id AS VARCHAR) AS gene_id, event_type AS gene_name, 'a' || CAST(event_id AS VARCHAR) AS tag,
  CAST(json_extract_string(props, '$.k') AS VARCHAR) AS level, '' AS note, CAST(NULL AS VARCHAR) AS absent,
  'a' || CAST(event_id AS VARCHAR) || '|b' AS tags, 5 AS keys, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS level_direct
FROM events"""


def sam_cigar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment lines written from line items, read back and filtered."""
    quantity, number = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    cigar = F.concat(
        number.cast("string"), F.lit("S"), (quantity * 2).cast("string"), F.lit("M"), number.cast("string"), F.lit("I"),
        quantity.cast("string"), F.lit("="), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("D"),
    )
    size = F.col("l_linenumber") * 2 + quantity * 3
    line = F.concat_ws(
        "\t", F.concat(F.lit("q"), F.col("l_orderkey").cast("string")),
        F.when(F.col("l_returnflag") == "R", "256").otherwise("0"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))).otherwise("*"),
        F.lit("1"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), size.cast("int")), F.lit("*"),
        F.lit("AS:i:9"), F.concat(F.lit("NM:i:"), F.round(F.col("l_discount") * 100).cast("int").cast("string")),
    )
    used = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    lines = spread(table(spark, sf_dir, "lineitem").select(used), "l_orderkey", "l_suppkey").select(line.alias("value"))
    references = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rname"), (F.col("s_nationkey") * 8 + 1).cast("long").alias("reference_length"))
    accepted = text.accept_alignments(text.parse_sam(lines), references)
    return accepted.groupBy("qname", "rname").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("identity"), 6).alias("identity"),
        F.round(F.max("cover_query"), 6).alias("cover_query"), F.round(F.max("cover_reference"), 6).alias("cover_reference"))


SAM_CIGAR = """
WITH a AS (SELECT 'q' || CAST(l_orderkey AS VARCHAR) AS qname, 'r' || CAST(l_suppkey AS VARCHAR) AS rname,
    CAST(l_quantity AS INT) * 3 AS m, l_linenumber AS i, CAST(round(l_tax * 100) AS INT) AS d, l_linenumber * 2 + CAST(l_quantity AS INT) * 3 AS ql,
    CAST(round(l_discount * 100) AS INT) AS nm, s_nationkey * 8 + 1 AS rl
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' AND l_linestatus = 'O'),
b AS (SELECT *, (m + i) * 100.0 / ql AS cq, (m + d) * 100.0 / rl AS cr, 100.0 * (1.0 - nm / (m + i + d)) AS ident FROM a)
SELECT qname, rname, count(*) AS n, round(max(CAST(ident AS DOUBLE)), 6) AS identity, round(max(CAST(cq AS DOUBLE)), 6) AS cover_query,
  round(max(CAST(cr AS DOUBLE)), 6) AS cover_reference
FROM b WHERE cq >= 80 AND cr >= 80 AND ident >= 95 GROUP BY 1, 2"""


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as profiler samples: users are recordings, the kind of event and its day the frames."""
    frames = F.array(F.concat(F.lit("java.lang."), "event_type"), F.concat(F.lit("org.sample."), "event_type", F.dayofmonth("ts").cast("string")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("recording"), "ts",
        F.when(F.col("event_type").isin("click", "view"), "cpu").otherwise("alloc").alias("kind"),
        profile.method_of(frames, ["org.sample."]).alias("method"), F.round(F.col("value") * 100).cast("long").alias("bytes"),
    )


def topk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_methods(profile.method_totals(profile_events(spark, sf_dir)), "allocated_bytes")


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.recording_summary(profile_events(spark, sf_dir))


def profile_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.round(F.col("value")).cast("long").alias("millis"))
    return profile.task_totals(log)


EVENT_SQL = """WITH e AS (SELECT 'rec' || CAST(user_id AS VARCHAR) AS recording, ts, CASE WHEN event_type IN ('click', 'view') THEN 'cpu' ELSE 'alloc' END AS kind,
  'org.sample.' || event_type || CAST(day(ts) AS VARCHAR) AS method, CAST(round(value * 100) AS BIGINT) AS bytes FROM events)"""
TOPK_PROFILE = EVENT_SQL + """
SELECT recording, method, count(*) FILTER (kind = 'cpu') AS cpu_samples, count(*) FILTER (kind = 'alloc') AS allocations,
  CAST(coalesce(sum(bytes) FILTER (kind = 'alloc'), 0) AS BIGINT) AS allocated_bytes
FROM e GROUP BY 1, 2 ORDER BY allocated_bytes DESC, recording, method LIMIT 100"""
PROFILE_SUMMARY = EVENT_SQL + """
SELECT recording, count(*) FILTER (kind = 'cpu') AS cpu_samples, CAST(coalesce(sum(bytes) FILTER (kind = 'alloc'), 0) AS BIGINT) AS allocated_bytes,
  epoch_us(max(ts)) - epoch_us(min(ts)) AS span_micros FROM e GROUP BY 1"""
PROFILE_TASKS = """
SELECT event_type AS task, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS millis, count(*) AS runs FROM events GROUP BY 1"""


def id_history_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, nations and regions as ids merged release by release."""
    def merged(df: DataFrame, old: str, new: str, first: float):
        return df.select(
            F.col(old).alias("old_id"), F.col(new).alias("new_id"), F.lit(first).cast("float").alias("old_release"),
            F.lit(first + 1).cast("float").alias("new_release"))

    def named(letter: str, key: str):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    customers = table(spark, sf_dir, "customer").select(
        named("C", "c_custkey").alias("o"), F.when(F.col("c_acctbal") < -900, "").otherwise(named("N", "c_nationkey")).alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select(named("S", "s_suppkey").alias("o"), named("N", "s_nationkey").alias("n"))
    nations = table(spark, sf_dir, "nation").select(
        named("N", "n_nationkey").alias("o"), F.when(F.col("n_nationkey") == 4, "").otherwise(named("R", "n_regionkey")).alias("n"))
    log = merged(customers, "o", "n", 1.0).unionByName(merged(suppliers, "o", "n", 1.0)).unionByName(merged(nations, "o", "n", 2.0))
    return history.successors(log, 1.0, 3.0)


ID_HISTORY = """
WITH RECURSIVE log AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS o, CASE WHEN c_acctbal < -900 THEN '' ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS n, 1 AS r FROM customer
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 1 FROM supplier
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey = 4 THEN '' ELSE 'R' || CAST(n_regionkey AS VARCHAR) END, 2 FROM nation),
walk AS (SELECT o AS id, n AS successor FROM log WHERE r = 1 AND n <> '' UNION SELECT w.id, l.n FROM walk w JOIN log l ON l.o = w.successor WHERE l.n <> '')
SELECT id, successor FROM walk WHERE successor NOT IN (SELECT o FROM log WHERE n = '')"""

QUERIES = {
    "fetch_sequences": (fetch_sequences, WINDOWS_SQL + '\nSELECT contig, "window", start, "end", t_sequence AS sequence FROM win'),
    "validate_sequence": (validate_sequence, WINDOWS_SQL + '\nSELECT contig, "window", t_sequence = q_sequence AS same FROM win'),
    "reverse_complement": (reverse_complements, REVERSE_COMPLEMENTS),
    "codon_translate": (codon_translate, CODON_TRANSLATE),
    "same_protein": (same_protein, SAME_PROTEIN),
    "coding_sequence_mapping": (coding_sequence_mapping, CODING_SEQUENCE_MAPPING),
    "alignment_fallback": (alignment_fallback, None),
    "endpoint_score": (endpoint_score, ENDPOINT_SCORE),
    "model_jaccard": (model_jaccard, MODEL_JACCARD),
    "chain_similarity": (chain_similarity, CHAIN_SIMILARITY),
    "reciprocal_best_hits": (reciprocal_best_hits, RECIPROCAL),
    "descriptor_print": (descriptor_print, DESCRIPTOR_PRINT),
    "reciprocal_model_hits": (reciprocal_model_hits, RECIPROCAL_MODELS),
    "bipartite_matching": (bipartite_matching, BIPARTITE_MATCHING),
    "exon_pairing": (exon_pairing, None),
    "analysis_differences": (analysis_differences, None),
    "comparator_diff_long": (comparator_diff_long, COMPARATOR_DIFF),
    "impact_levels": (impact_levels, "SELECT impact, difference, count(*) AS n FROM (" + COMPARATOR_DIFF + ") GROUP BY 1, 2"),
    "transcript_comparators": (transcript_comparators, TRANSCRIPT_COMPARATORS),
    "gene_comparators": (gene_comparators, GENE_COMPARATORS),
    "attribute_parse": (attribute_parse, ATTRIBUTE_PARSE),
    "sam_cigar_filter": (sam_cigar_filter, SAM_CIGAR),
    "topk_profile": (topk_profile, TOPK_PROFILE),
    "profile_summary": (profile_summary, PROFILE_SUMMARY),
    "profile_tasks": (profile_tasks, PROFILE_TASKS),
    "id_history_closure": (id_history_closure, ID_HISTORY),
}
