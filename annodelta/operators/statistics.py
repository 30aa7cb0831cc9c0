"""Descriptive statistics of one annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import Annotation, biotype, length, with_introns

# Feature types counted by the statistics, in report order.
COUNTED_TYPES = [C.EXON, C.INTRON, C.CDS, C.UTR5, C.UTR3, C.START_CODON, C.STOP_CODON]
# Feature types whose lengths are listed.
MEASURED_TYPES = [C.EXON, C.INTRON, C.CDS, C.UTR5, C.UTR3]


def global_counts(annotation: Annotation) -> DataFrame:
    """(name, count) for genes, transcripts and every counted feature type, zeros included."""
    genes = annotation.genes.agg(F.count(F.lit(1)).alias("genes"))
    transcripts = annotation.transcripts.agg(F.count(F.lit(1)).alias("transcripts"))
    features = annotation.features.agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in COUNTED_TYPES]
    )

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("count")) for c in df.columns
        ])).alias("x")).select("x.*")

    return long(genes).unionByName(long(transcripts)).unionByName(long(features))


def biotype_histogram(rows: DataFrame, attribute: str) -> DataFrame:
    return rows.groupBy(biotype(attribute).alias("biotype")).agg(F.count(F.lit(1)).alias("count"))


def transcripts_per_gene(annotation: Annotation) -> DataFrame:
    """(contig, gene_id, n), genes without transcripts included."""
    counts = annotation.transcripts.groupBy("contig", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    return annotation.genes.select("contig", "gene_id").join(counts, ["contig", "gene_id"], "left").select(
        "contig", "gene_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def regions_per_transcript(annotation: Annotation, types: tuple[str, ...] = (C.EXON, C.INTRON)) -> DataFrame:
    """Number of exons and introns of every transcript, zeros included."""
    counts = annotation.features.where(F.col("type").isin(*types)).groupBy("contig", "transcript_id").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types]
    )
    return annotation.transcripts.select("contig", "transcript_id").join(
        counts, ["contig", "transcript_id"], "left"
    ).select("contig", "transcript_id", *[F.coalesce(f"n_{t}", F.lit(0)).cast("long").alias(f"n_{t}") for t in types])


def lengths(annotation: Annotation, introns: bool = False) -> DataFrame:
    """(kind, length) of genes, transcripts and the measured regions, one row each; with ``introns`` also of those that follow
    from the exons. These lie between children, so the extent of a transcript is taken without them.

    A transcript lacking either coordinate is measured by the extent of its children.
    """
    keys = ["contig", "transcript_id"]
    incomplete = F.col("start").isNull() | F.col("end").isNull()
    extent = annotation.features.groupBy(*keys).agg(F.min("start").alias("cs"), F.max("end").alias("ce"))
    transcripts = annotation.transcripts.join(extent, keys, "left").select(
        F.lit(C.TRANSCRIPT).alias("kind"),
        (F.when(incomplete, F.col("ce")).otherwise(F.col("end"))
         - F.when(incomplete, F.col("cs")).otherwise(F.col("start")) + 1).alias("length"),
    )
    genes = annotation.genes.select(F.lit(C.GENE).alias("kind"), length().alias("length"))
    features = (with_introns(annotation) if introns else annotation).features
    regions = features.where(F.col("type").isin(MEASURED_TYPES)).select(
        F.col("type").alias("kind"), length().alias("length")
    )
    return genes.unionByName(transcripts).unionByName(regions).where(F.col("length").isNotNull())
