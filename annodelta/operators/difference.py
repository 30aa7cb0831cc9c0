"""The long difference table: one row per reported difference, tagged by impact."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import PART, Annotation, per_transcript, transcript_extents
from annodelta.compat import Compat
from annodelta.config import Comparison
from annodelta.operators.comparators import Comparator, of_grain
from annodelta.operators.genome import CHUNK_BASES, compare_spans
from annodelta.operators.regions import PAIR_KEYS, pair_regions
from annodelta.session import cut_lineage

# Property impacts that the historic key names can reach.
NARROW_IMPACT_KEYS = {"start": "start", "stop": "stop", "length": "length"}


def impact(kind: Column, label: str, config: Comparison, compat: Compat = Compat(), fallback: str | None = None) -> Column:
    """Higher of the impacts configured for the feature type and for the property; MODERATE if none.

    ``fallback`` stands in for the type's impact where none is configured (used for transcripts).
    """
    names = {"seq": "sequence", "protein": "same_protein"}
    if compat.narrow_impact_keys:
        prop = config.impacts.get(NARROW_IMPACT_KEYS.get(label, ""))
    else:
        prop = config.impacts.get(names.get(label, label)) or config.impacts.get(f"transcript_{label}")
    rank = {level: F.lit(n) for n, level in enumerate(C.IMPACTS)}
    of_kind = F.lit(None).cast("int")
    for name, level in config.impacts.items():
        if name in C.FEATURE_TYPES:
            of_kind = F.when(kind == name, rank[level]).otherwise(of_kind)
    if fallback:
        of_kind = F.coalesce(of_kind, rank[fallback])
    of_prop = rank[prop] if prop else F.lit(None).cast("int")
    best = F.coalesce(F.greatest(of_kind, of_prop), rank["MODERATE"])
    return F.element_at(F.array(*[F.lit(x) for x in C.IMPACTS]), best + 1)


def transcript_pairs(matches: DataFrame, target: Annotation, query: Annotation, config: Comparison) -> DataFrame:
    """Matched pairs with ids, biotypes, strand and child extent of both sides, and the parts they lie in if known.

    A biotype allow list lets a pair through if either transcript is on it.
    """
    def side(a: Annotation, p: str, name: str) -> DataFrame:
        extent = transcript_extents(a.features, p == "q_")
        genes = a.genes.select("contig", "gene_id", F.coalesce("gene_biotype", "source").alias("gene_kind"))
        return (
            a.transcripts.join(extent, per_transcript(extent, "contig", "transcript_id"), "left")
            .join(genes, ["contig", "gene_id"], "left")
            .select(
                "contig", F.col("transcript_id").alias(name), F.col("gene_id").alias(p + "gene_id"),
                F.col("gene_kind").alias(p + "gene_biotype"),
                F.coalesce("transcript_biotype", "source").alias(p + "biotype"),
                F.col("cs").alias(p + "start"), F.col("ce").alias(p + "end"), F.col("fwd").alias(p + "fwd"),
                *(F.col(c).alias(p + c) for c in extent.columns if c == PART),
            )
        )

    pairs = (
        matches.select(*PAIR_KEYS)
        .join(side(target, "t_", "target_transcript_id"), ["contig", "target_transcript_id"])
        .join(side(query, "q_", "query_transcript_id"), ["contig", "query_transcript_id"])
    )
    if config.allowed_biotypes:
        allowed = list(config.allowed_biotypes)
        pairs = pairs.where(F.col("t_biotype").isin(allowed) | F.col("q_biotype").isin(allowed))
    return cut_lineage(pairs)  # read by every part of the report


def _differences(comparators: Iterable[Comparator], config: Comparison, compat: Compat, kind: Column, fallback: str | None = None) -> Column:
    """Array of (order_key, difference, impact) of the comparators that fire."""
    found = []
    for c in comparators:
        fires = F.coalesce(c.changed(config.threshold(c.name), compat), F.lit(False))
        if c.only_type:
            fires = fires & (kind == c.only_type)
        found.append(F.when(fires, F.struct(
            F.lit(c.order_key).alias("order_key"), F.lit(c.label).alias("difference"),
            impact(kind, c.label, config, compat, fallback).alias("impact"),
        )))
    if not found:
        return F.array().cast("array<struct<order_key:int,difference:string,impact:string>>")
    return F.array_compact(F.array(*found))


def _row(key: int, label: str, kind: Column, config: Comparison, compat: Compat) -> Column:
    return F.array(F.struct(
        F.lit(key).alias("order_key"), F.lit(label).alias("difference"), impact(kind, label, config, compat).alias("impact")
    ))


def region_differences(
    regions: DataFrame, config: Comparison, compat: Compat = Compat(), with_sequences: bool = False
) -> DataFrame:
    """Region rows with an array ``found`` of their differences, unchanged regions included.

    ``regions`` come from :func:`pair_regions`, with t_fwd and q_fwd, and with sequences when asked.
    """
    kind = F.col("type")
    chosen = [c for c in of_grain("region") if config.enabled(c.name) and (with_sequences or not c.needs_sequence)]
    both = F.col("t_start").isNotNull() & F.col("q_start").isNotNull()
    found = (
        F.when(F.col("absent") == "TARGET", _row(200, "featureTypeMissingInTargetTranscript", kind, config, compat))
        .when(F.col("absent") == "QUERY", _row(210, "featureTypeMissingInQueryTranscript", kind, config, compat))
        .when(both, _differences(chosen, config, compat, kind))
        .when(F.col("t_start").isNull(), _row(350, "missingFeatureEntryFileInTarget", kind, config, compat))
        .otherwise(_row(360, "missingFeatureEntryFileInQuery", kind, config, compat))
    )
    return regions.withColumn("found", found)


def difference_table(
    pairs: DataFrame, target: Annotation, query: Annotation, config: Comparison,
    target_genome: DataFrame | None = None, query_genome: DataFrame | None = None,
    compat: Compat = Compat(), chunk: int = CHUNK_BASES,
) -> DataFrame:
    """All differences of the given transcript pairs (see :func:`transcript_pairs`).

    The 18 report columns plus ``order_key``; all values are strings except the key.
    """
    regions = pair_regions(pairs, target.features, query.features, list(config.feature_types), compat)
    strands = ["t_fwd", "q_fwd"]
    with_sequences = target_genome is not None and query_genome is not None
    if with_sequences and (config.enabled("sequence") or config.enabled("same_protein")):
        # Only regions of equal length need their text: a different length already decides.
        length_t, length_q = F.col("t_end") - F.col("t_start"), F.col("q_end") - F.col("q_start")
        keys = [*PAIR_KEYS[1:], "type", "t_start", "t_end", "q_start", "q_end"]
        wanted = regions.where(length_t == length_q).select("contig", *keys).distinct()
        texts = compare_spans(wanted, target_genome, query_genome, keys, chunk)
        # Only texts are read along the strand; otherwise the changed regions alone learn it, for the report.
        regions = regions.join(pairs.select(*PAIR_KEYS, *strands), PAIR_KEYS).join(texts, ["contig", *keys], "left")
        strands = []
    elif with_sequences:
        with_sequences = False
    flagged = region_differences(regions, config, compat, with_sequences)

    # Both grains of the report read the changed regions; pairing them is the costly part.
    changed = cut_lineage(flagged.where(F.size("found") > 0))
    per_pair = changed.groupBy(*PAIR_KEYS).agg(
        F.max(F.exists("found", lambda x: x["difference"] == "seq")).alias("seq_changed")
    )
    kind = F.lit(C.TRANSCRIPT)
    base = config.impacts.get(C.TRANSCRIPT, "MODERATE")
    own = _differences(
        [c for c in of_grain("transcript") if config.enabled(c.name)], config, compat, kind, base
    )
    seq = F.when(F.col("seq_changed"), F.array(F.struct(
        F.lit(120).alias("order_key"), F.lit("seq").alias("difference"),
        impact(kind, "seq", config, compat, base).alias("impact"),
    ))).otherwise(F.array().cast("array<struct<order_key:int,difference:string,impact:string>>"))
    none = F.array(F.struct(F.lit(20).alias("order_key"), F.lit("none").alias("difference"), F.lit("NONE").alias("impact")))
    transcripts = (
        pairs.join(per_pair, PAIR_KEYS, "left")
        .withColumn("found", F.concat(own, seq))
        .withColumn("found", F.when((F.size("found") == 0) & F.col("seq_changed").isNull(), none).otherwise(F.col("found")))
        .withColumn("found", F.explode("found"))
    )
    # Coordinates are taken from the comparators of the start and stop; without them they are unknown.
    located = any(config.enabled(c) for c in ("transcript_start", "transcript_stop", "transcript_length"))

    def text(c: str, missing: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(missing))

    def sign(c: str) -> Column:
        return F.when(F.col(c), "+").when(~F.col(c), "-").otherwise("")

    def report(df: DataFrame, kind: Column, coordinates: list[Column]) -> DataFrame:
        return df.select(
            F.col("found.order_key").alias("order_key"), F.col("found.impact").alias("impact"), "contig",
            F.col("t_gene_id").alias("targetGeneId"), F.col("q_gene_id").alias("queryGeneId"),
            F.col("t_gene_biotype").alias("targetBioType"), F.col("q_gene_biotype").alias("queryBiotype"),
            kind.alias("featureType"), F.col("found.difference").alias("difference"),
            F.col("target_transcript_id").alias("targetTranscriptId"), F.col("query_transcript_id").alias("queryTranscriptId"),
            F.col("t_biotype").alias("targetTranscriptBiotype"), F.col("q_biotype").alias("queryTranscriptBiotype"),
            *[c.alias(n) for c, n in zip(coordinates, C.DIFFERENCE_COLUMNS[12:16])],
            sign("t_fwd").alias("targetStrand"), sign("q_fwd").alias("queryStrand"),
        )

    order = ["t_start", "q_start", "t_end", "q_end"]
    own_place = [text(c, "null") if located else F.lit("null") for c in order]
    rows = report(transcripts, F.lit(C.TRANSCRIPT), own_place)
    details = pairs.select(*PAIR_KEYS, "t_gene_id", "q_gene_id", "t_gene_biotype", "q_gene_biotype", "t_biotype", "q_biotype", *strands)
    whole_type = F.col("absent").isNotNull()
    place = [F.when(whole_type, F.lit("")).otherwise(text(c, "-1")) for c in order]
    region_rows = report(
        changed.withColumn("found", F.explode("found")).join(details, PAIR_KEYS), F.col("type"), place
    )
    return rows.unionByName(region_rows)


def ordered_report(differences: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """Tab-joined report lines with their sort columns (contig, order_key, line)."""
    columns = C.DIFFERENCE_COLUMNS
    full = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    line = full
    if compat.none_row_short:
        swapped = [*columns[:4], "queryBiotype", "targetBioType", *columns[6:16], "queryStrand"]
        line = F.when(F.col("difference") == "none", F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in swapped]))
        line = line.when(F.col("order_key").isin(200, 210), F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns[:12]]))
        line = line.otherwise(full)
    return differences.select("contig", "order_key", line.alias("line"))
