"""The annotation model: three tables keyed by contig and ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annodelta import constants as C

#: Optional column of ``features``: a value that follows from the transcript id, alike in both releases, by which the rows
#: are dealt over the tasks already. Steps per transcript add it to their keys, and need no shuffle then.
PART = "part"


def per_transcript(features: DataFrame, *keys: str) -> list[str]:
    """``keys`` of a transcript, with ``part`` where the features have it."""
    return [*keys, *(c for c in features.columns if c == PART)]


def are_listed(features: DataFrame) -> bool:
    """Whether ``features`` are lists, one row per transcript, of both releases (see :class:`Annotation`)."""
    return "features" in features.columns


def of_both_sides(target: DataFrame, query: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` makes of the features of both releases, with ``is_query``; lists hold both already."""
    if are_listed(target):
        return make(target)
    # The sides are put together before they are joined, so that no two partitionings meet in a union later on.
    return make(target).withColumn("is_query", F.lit(False)).unionByName(make(query).withColumn("is_query", F.lit(True)))


def join_by_transcript(
    rows: DataFrame, lists: DataFrame, how: str = "left", keys: tuple[str, ...] = ("contig", "is_query", "transcript_id")
) -> DataFrame:
    """``rows`` with what ``lists`` know of a transcript. Where both have ``part`` they meet by it alone, so that the lists,
    which lie so already, are not shuffled."""
    keys = list(keys)
    if not (PART in rows.columns and PART in lists.columns):
        return rows.join(lists.drop(PART), keys, how).drop(PART)
    own = lists.where(" and ".join(f"{k} is not null" for k in keys)).withColumnsRenamed({k: f"_{k}" for k in [*keys, PART]})
    # No plain equality: it would be taken for a key to shuffle by.
    same = F.array_contains(F.array(F.struct(*(F.col(f"_{k}").alias(k) for k in keys))), F.struct(*keys))
    return rows.join(own, (F.col(PART) == F.col(f"_{PART}")) & same, how).drop(PART, *(f"_{k}" for k in [*keys, PART]))


@dataclass(frozen=True)
class Annotation:
    """One annotation release.

    ``genes``       contig, gene_id, gene_name, gene_biotype, source, start, end, fwd
    ``transcripts`` contig, gene_id, transcript_id, transcript_name, transcript_biotype, source,
                    start, end, fwd
    ``features``    contig, gene_id, transcript_id, type, start, end, fwd, ord, and if known ``part``;
                    or lists of both releases alike: is_query, contig, transcript_id, part and ``features``
                    (type, start, end, ord, fwd; may be empty), at most one row per transcript, not filtered by
                    their contents (which would make them twice). ``transcripts`` know their ``part`` then, too.

    Coordinates are 1-based and inclusive on both ends. ``ord`` is any orderable value giving the
    file order of the children of a transcript.
    """

    genes: DataFrame
    transcripts: DataFrame
    features: DataFrame


def length(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start) + 1


def biotype(attribute: str, source: str = "source") -> Column:
    """Biotype attribute, or the source column where the attribute is absent."""
    return F.coalesce(F.col(attribute), F.col(source))


def is_protein_coding(attribute: str = "gene_biotype", source: str = "source") -> Column:
    hit = (F.col(attribute) == C.PROTEIN_CODING) | (F.col(source) == C.PROTEIN_CODING)
    return F.coalesce(hit, F.lit(False))


def child_extent(features: DataFrame) -> DataFrame:
    """Smallest start and largest end of the children of each transcript."""
    return features.groupBy("contig", "transcript_id").agg(
        F.min("start").alias("child_start"), F.max("end").alias("child_end")
    )


def fill_coordinates(transcripts: DataFrame, features: DataFrame) -> DataFrame:
    """Replace an absent transcript start or end by the extent of its children."""
    keys = ["contig", "transcript_id"]
    return (
        transcripts.join(child_extent(features), keys, "left")
        .withColumn("start", F.coalesce("start", "child_start"))
        .withColumn("end", F.coalesce("end", "child_end"))
        .select(*transcripts.columns)
    )


def synthesize_introns(features: DataFrame) -> DataFrame:
    """Introns between neighbouring exons of a transcript, in coordinate order.

    Touching or overlapping exons leave no room and give no intron.
    """
    by_start = Window.partitionBy("contig", "transcript_id").orderBy("start", "end", "ord")
    return (
        features.where(F.col("type") == C.EXON)
        .withColumn("next_start", F.lead("start").over(by_start))
        .where(F.col("next_start") > F.col("end") + 1)
        .select(
            "contig", "gene_id", "transcript_id",
            F.lit(C.INTRON).alias("type"),
            (F.col("end") + 1).alias("start"),
            (F.col("next_start") - 1).alias("end"),
            "fwd", "ord",
        )
    )


def with_introns(annotation: Annotation) -> Annotation:
    """Add synthesized introns to the transcripts that list none. One pass, one shuffle."""
    features = annotation.features
    if are_listed(features):
        return Annotation(annotation.genes, annotation.transcripts, introns_in_lists(features))
    keys = per_transcript(features, "contig", "transcript_id")
    # One order serves both: exons stand last in their transcript, each before the next of them.
    exons_last = Window.partitionBy(*keys).orderBy("is_exon", "start", "end", "ord")
    of_transcript = exons_last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.col("is_exon") & ~F.col("listed") & (F.col("next_start") > F.col("end") + 1)
    intron = F.struct(
        F.lit(C.INTRON).alias("type"), (F.col("end") + 1).alias("start"), (F.col("next_start") - 1).alias("end")
    )
    rows = (
        features.withColumn("is_exon", F.col("type") == C.EXON)
        .withColumn("listed", F.max(F.col("type") == C.INTRON).over(of_transcript))
        .withColumn("next_start", F.lead("start").over(exons_last))
        .withColumn("row", F.explode(F.array_compact(F.array(F.struct("type", "start", "end"), F.when(gap, intron)))))
    )
    kept = [F.col(f"row.{c}").alias(c) if c in ("type", "start", "end") else F.col(c) for c in features.columns]
    return Annotation(annotation.genes, annotation.transcripts, rows.select(*kept))


def introns_in_lists(lists: DataFrame) -> DataFrame:
    """As :func:`with_introns`, inside the lists."""
    exons = F.sort_array(F.transform(F.filter("features", lambda f: f["type"] == C.EXON), lambda f: F.struct(
        *(f[c].alias(c) for c in ("start", "end", "ord", "fwd")))))

    def gap(exon: Column, place: Column) -> Column:
        behind = F.get("exons", place + 1)["start"]
        return F.when(behind > exon["end"] + 1, F.struct(
            F.lit(C.INTRON).alias("type"), (exon["end"] + 1).alias("start"), (behind - 1).alias("end"), exon["ord"].alias("ord"), exon["fwd"].alias("fwd")))

    listed = F.coalesce(F.exists("features", lambda f: f["type"] == C.INTRON), F.lit(False))
    filled = F.when(listed, F.col("features")).otherwise(F.concat("features", F.array_compact(F.transform("exons", gap))))
    return lists.withColumn("exons", exons).withColumn("features", filled).drop("exons")


def transcript_extents(features: DataFrame, is_query: bool) -> DataFrame:
    """contig, transcript_id, cs, ce and if known part: the extent of the children of each transcript of a release."""
    if are_listed(features):
        return features.where(F.col("is_query") == is_query).select(
            "contig", "transcript_id", PART, F.array_min("features.start").alias("cs"), F.array_max("features.end").alias("ce"))
    return features.groupBy("contig", "transcript_id").agg(F.min("start").alias("cs"), F.max("end").alias("ce"))


def synthesize_genes(transcripts: DataFrame) -> DataFrame:
    """Gene rows derived from transcripts, for releases that list none."""
    return transcripts.groupBy("contig", "gene_id").agg(
        F.min("gene_name").alias("gene_name"),
        F.min("gene_biotype").alias("gene_biotype"),
        F.min("source").alias("source"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("fwd").alias("fwd"),
    )
