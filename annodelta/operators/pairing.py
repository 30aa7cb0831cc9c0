"""Pairing by id and by rank: inner, full outer and leftover rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import PART, are_listed, join_by_transcript, per_transcript
from annodelta.operators.genome import CHUNK_BASES, compare_spans


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def pair_by_id(target: DataFrame, query: DataFrame, keys: list[str], how: str = "full_outer") -> DataFrame:
    """Join two releases on ``keys``; the other columns get the prefixes ``t_`` and ``q_``.

    ``side_state`` tells both / missing_in_query / missing_in_target.
    """
    t = _prefixed(target, "t_", keys).withColumn("in_t", F.lit(True))
    q = _prefixed(query, "q_", keys).withColumn("in_q", F.lit(True))
    state = (
        F.when(F.col("in_t").isNull(), "missing_in_target")
        .when(F.col("in_q").isNull(), "missing_in_query")
        .otherwise("both")
    )
    return t.join(q, keys, how).withColumn("side_state", state).drop("in_t", "in_q")


def pair_by_rank(target: DataFrame, query: DataFrame) -> DataFrame:
    """Pair the i-th region of a type with the i-th of the other release, per transcript id.

    Regions are ranked by (start, end, ord); the longer side keeps its leftovers unpaired.
    """
    keys = ["contig", "transcript_id", "type"]

    def ranked(features: DataFrame, is_query: bool) -> DataFrame:
        order = Window.partitionBy(*per_transcript(features, *keys)).orderBy("start", "end", "ord")
        return features.withColumn("rank", F.row_number().over(order)).select(
            *keys, "rank", "start", "end", "fwd", F.lit(is_query).alias("is_query"))

    # One shuffle of both sides by transcript, which pairs them and serves whatever a caller asks per transcript.
    both = ranked(target, False).unionByName(ranked(query, True)).repartition("contig", "transcript_id")
    # A null in a key equals nothing, so it keeps the sides apart.
    apart = F.when(F.concat(*[F.col(k).cast("string") for k in keys]).isNull(), F.col("is_query")).alias("apart")
    paired = both.groupBy(*keys, "rank", apart).agg(
        *[F.max(F.when(F.col("is_query") == is_query, F.col(c))).alias(f"{side}_{c}")
          for side, is_query in (("t", False), ("q", True)) for c in ("start", "end", "fwd")],
        F.min("is_query").alias("only_query"), F.max("is_query").alias("any_query"))
    state = F.when(F.col("only_query"), "missing_in_target").when(~F.col("any_query"), "missing_in_query").otherwise("both")
    return paired.withColumn("side_state", state).drop("apart", "only_query", "any_query")


def _regions_by_rank(df: DataFrame) -> DataFrame:
    """As :func:`pair_by_rank` with ``type_in_both``, from rows with the lists ``t`` and ``q`` of a transcript; types are known."""
    def ranked(side: str, kind: Column) -> Column:
        return F.sort_array(F.transform(F.filter(side, lambda f: f["type"] == kind), lambda f: F.struct(
            *(f[c].alias(c) for c in ("start", "end", "ord", "fwd")))))

    kinds = F.array_distinct(F.concat(F.col("t.type"), F.col("q.type")))
    of_kind = df.withColumn("type", F.explode(kinds)).withColumns({"t": ranked("t", F.col("type")), "q": ranked("q", F.col("type"))})
    sizes = F.size("t"), F.size("q")
    rows = of_kind.withColumn("type_in_both", F.least(*sizes) > 0).withColumn("rank", F.explode(F.sequence(F.lit(1), F.greatest(*sizes))))
    state = F.when(F.col("rank") > sizes[0], "missing_in_target").when(F.col("rank") > sizes[1], "missing_in_query").otherwise("both")
    return rows.withColumn("side_state", state).withColumns({
        f"{side}_{c}": F.get(F.col(side), F.col("rank") - 1)[c] for side in "tq" for c in ("start", "end", "fwd")}).drop("t", "q")


def _lists_of_both(lists: DataFrame) -> DataFrame:
    """part, contig, transcript_id and the lists of the target (t) and of the query (q) release, empty where there is none."""
    sides = lists.groupBy(PART, "contig", "transcript_id").agg(*[
        F.first(F.when(F.col("is_query") == is_query, F.col("features")), ignorenulls=True).alias(side) for side, is_query in (("t", False), ("q", True))])
    return sides.withColumns({
        side: F.coalesce(side, F.filter(other, lambda f: F.lit(False))) for side, other in (("t", "q"), ("q", "t"))})


def exact_gene_difference(pairs: DataFrame) -> DataFrame:
    """Flags of the exact gene comparison: length, strand, start and stop, no thresholds."""
    def changed(c: str) -> Column:
        return ~F.col(f"t_{c}").eqNullSafe(F.col(f"q_{c}"))

    length_changed = ~(F.col("t_end") - F.col("t_start")).eqNullSafe(F.col("q_end") - F.col("q_start"))
    return pairs.withColumns({
        "length_changed": length_changed,
        "strand_changed": changed("fwd"),
        "start_changed": changed("start"),
        "stop_changed": changed("end"),
    })


def transcripts_of_gene_pairs(gene_pairs: DataFrame, target: DataFrame, query: DataFrame) -> DataFrame:
    """Full outer pairs of transcripts by id, each inside a gene that both releases know.

    A transcript that moved to another gene is missing on both sides.
    """
    shared = gene_pairs.where(F.col("side_state") == "both").select("contig", "gene_id")
    known = [x.join(shared, ["contig", "gene_id"], "left_semi").select(x.columns) for x in (target, query)]
    return pair_by_id(*known, ["contig", "gene_id", "transcript_id"])


#: Differences that are listed but do not by themselves make a gene a different one.
QUIET = ["start", "stop", "position", "missingFeatureEntryFile1", "missingFeatureEntryFile2"]


SPAN = ["t_start", "t_end", "q_start", "q_end"]


def unequal_texts(pairs: list[DataFrame], target_genome: DataFrame, query_genome: DataFrame, chunk: int = CHUNK_BASES) -> DataFrame:
    """(contig, SPAN, unequal): spans of equal length among ``pairs`` whose letters differ; each span is read once.

    The text is the genome's, on no strand. A text that only one genome covers differs.
    """
    spans = None
    for df in pairs:
        own = df.where("side_state = 'both' AND t_end - t_start = q_end - q_start").select("contig", *SPAN)
        spans = own if spans is None else spans.unionByName(own)
    compared = compare_spans(spans.distinct(), target_genome, query_genome, SPAN, chunk)
    return compared.where(~F.col("t_sequence").eqNullSafe(F.col("q_sequence"))).select("contig", *SPAN, F.lit(True).alias("unequal"))


def old_style_differences(
    gene_pairs: DataFrame, transcript_pairs: DataFrame, region_pairs: DataFrame,
    target_genome: DataFrame | None = None, query_genome: DataFrame | None = None, chunk: int = CHUNK_BASES,
) -> DataFrame:
    """The three-column difference list (gene_id, category, difference) of the id based comparison.

    A gene that is the same but for its place appears once with empty category and difference; other genes
    have a row for each difference of the gene, its transcripts and their regions. A gene known to one release only
    is missingInFile1 (target) or missingInFile2 (query). Texts of other length differ (seq); those of equal
    length are compared if both genomes are given, and else taken as equal.
    """
    texts = None
    if target_genome is not None and query_genome is not None:
        texts = unequal_texts([gene_pairs, transcript_pairs, region_pairs], target_genome, query_genome, chunk)

    def difference(pairs: DataFrame) -> DataFrame:
        flagged = exact_gene_difference(pairs)
        if texts is None:
            return flagged.withColumn("text_changed", F.col("length_changed"))
        return flagged.join(texts, ["contig", *SPAN], "left").withColumn(
            "text_changed", F.col("length_changed") | F.col("unequal").isNotNull()).drop("unequal")

    genes = difference(gene_pairs)
    both, in_query, in_target = (F.col("side_state") == s for s in ("both", "missing_in_target", "missing_in_query"))

    def unpivot(df: DataFrame, category: str, flags: dict[str, Column], suffix: Column | None) -> DataFrame:
        labels = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
        text = F.col("label") if suffix is None else F.concat_ws("_", F.col("label"), suffix)
        return df.withColumn("label", F.explode(labels)).select(
            "contig", "gene_id", F.lit(category).alias("category"), text.alias("difference"),
            (~F.col("label").isin(QUIET)).alias("loud"),
        )

    rows = unpivot(genes, "gene", {
        "missingInFile1": in_query, "missingInFile2": in_target,
        "length": both & F.col("length_changed"), "seq": both & F.col("text_changed"),
        "strand": both & F.col("strand_changed"), "start": both & F.col("start_changed"), "stop": both & F.col("stop_changed"),
    }, None).unionByName(unpivot(difference(transcript_pairs), "transcript", {
        "missingInFile1": in_query, "missingInFile2": in_target,
        "length": both & F.col("length_changed"), "seq": both & F.col("text_changed"),
        "start": both & F.col("start_changed"), "stop": both & F.col("stop_changed"),
    }, F.col("transcript_id"))).unionByName(unpivot(difference(region_pairs), "feature", {
        "missingInTranscript1": in_query & ~F.col("type_in_both") & (F.col("rank") == 1),
        "missingInTranscript2": in_target & ~F.col("type_in_both") & (F.col("rank") == 1),
        "missingFeatureEntryFile1": in_query & F.col("type_in_both"),
        "missingFeatureEntryFile2": in_target & F.col("type_in_both"),
        "length": both & F.col("length_changed"), "seq": both & F.col("text_changed"),
        "position": both & (F.col("start_changed") | F.col("stop_changed")),
    }, F.concat_ws("_", "transcript_id", "type")))
    same = genes.where(both).select(
        "contig", "gene_id", F.lit("").alias("category"), F.lit("").alias("difference"), F.lit(False).alias("loud")
    )
    changed = F.max("loud").over(Window.partitionBy("contig", "gene_id"))
    return rows.unionByName(same).withColumn("changed", changed).where(
        F.col("changed") == (F.col("category") != "")
    ).select("gene_id", "category", "difference")


def old_style_region_pairs(target: DataFrame, query: DataFrame, transcript_pairs: DataFrame) -> DataFrame:
    """Rank-paired regions of the transcripts both releases know, with their gene id.

    ``type_in_both`` tells whether both transcripts have regions of the type at all. Regions in lists are ranked and paired where
    they lie; ``transcript_pairs`` then know the parts.
    """
    shared = transcript_pairs.where(F.col("side_state") == "both").select(
        "contig", "transcript_id", "gene_id", *(F.col(c).alias(PART) for c in transcript_pairs.columns if c == f"t_{PART}"))
    if are_listed(target):
        return _regions_by_rank(join_by_transcript(shared, _lists_of_both(target), "inner", ("contig", "transcript_id")))
    in_both = F.max(F.col("side_state") == "both").over(Window.partitionBy("contig", "transcript_id", "type"))
    return pair_by_rank(target, query).withColumn("type_in_both", in_both).join(shared, ["contig", "transcript_id"])


LIFTED_COLUMNS = [
    "contig", "query_genes", "target_genes", "lifted_query_genes", "normal_pairs", "lifted_pairs",
    "differ_by_position", "differ_by_sequence",
]


def lifted_pairs(lifted_genes: DataFrame, target_genes: DataFrame) -> DataFrame:
    """Gene pairs with equal id within a contig, with a flag for moved ends."""
    pairs = pair_by_id(target_genes, lifted_genes, ["contig", "gene_id"], "inner")
    moved = (F.col("t_start") != F.col("q_start")) | (F.col("t_end") != F.col("q_end"))
    return pairs.withColumn("moved", F.coalesce(moved, F.lit(False)))


def lifted_statistics(
    query_genes: DataFrame, target_genes: DataFrame, lifted_genes: DataFrame, by_sequence: DataFrame
) -> DataFrame:
    """Counts per contig and a TOTAL row; ``by_sequence`` lists (contig, gene_id) pairs that differ.

    Every input is reduced to counts per contig before anything is combined.
    """
    normal = pair_by_id(target_genes, query_genes, ["contig", "gene_id"], "inner")
    lifted = lifted_pairs(lifted_genes, target_genes)
    counted = {
        "query_genes": query_genes, "target_genes": target_genes, "lifted_query_genes": lifted_genes,
        "normal_pairs": normal, "lifted_pairs": lifted, "differ_by_position": lifted.where("moved"),
        "differ_by_sequence": by_sequence,
    }
    parts = None
    for name, df in counted.items():
        part = df.groupBy("contig").count().select("contig", F.lit(name).alias("name"), "count")
        parts = part if parts is None else parts.unionByName(part)
    sums = [
        F.coalesce(F.sum(F.when(F.col("name") == n, F.col("count"))), F.lit(0)).cast("long").alias(n)
        for n in LIFTED_COLUMNS[1:]
    ]
    return parts.rollup("contig").agg(*sums).select(
        F.coalesce("contig", F.lit("TOTAL")).alias("contig"), *LIFTED_COLUMNS[1:]
    )
