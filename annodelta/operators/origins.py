"""Set filters over the recorded reasons of a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta import constants as C


def found_origins(mapping_origins: Column) -> Column:
    """Recognised reasons of a rendered origin list; unknown tokens are ignored.

    A distance of 0 means the genes overlap, any other distance (also -1) counts as DISTANCE.
    """
    token = F.split(mapping_origins, ",")
    named = F.transform(
        token,
        lambda x: F.when(F.trim(x) == "DISTANCE:0", F.lit(C.OVERLAPPING))
        .when(F.trim(x).startswith("DISTANCE:"), F.lit(C.DISTANCE))
        .otherwise(F.trim(x)),
    )
    return F.array_distinct(F.filter(named, lambda x: x.isin(C.MAPPING_ORIGINS)))


def filter_by_origins(
    mapping: DataFrame, allowed: list[str], require_all: bool, column: str = "mapping_origins"
) -> DataFrame:
    """Rows whose reasons contain all (or any) of ``allowed``."""
    wanted = F.array(*[F.lit(x) for x in allowed])
    found = found_origins(F.col(column))
    if require_all:
        keep = F.size(F.array_except(wanted, found)) == 0
    else:
        keep = F.arrays_overlap(found, wanted)
    return mapping.where(keep)


def parse_mapping_rows(mapping: DataFrame) -> DataFrame:
    """Split the origin column of a mapping table into an ``origins`` array and a ``distance``."""
    tokens = F.transform(F.split("mapping_origins", ","), lambda x: F.trim(x))
    distance = F.element_at(F.filter(tokens, lambda x: x.contains(":")), 1)
    return mapping.select(
        "contig",
        F.col("targetId").alias("target_gene_id"),
        F.col("queryId").alias("query_gene_id"),
        F.col("targetTranscriptId").alias("target_transcript_id"),
        F.col("queryTranscriptId").alias("query_transcript_id"),
        F.filter(tokens, lambda x: ~x.contains(":") & (x != C.TRANSCRIPT_ID_MAPPING)).alias("origins"),
        F.split(distance, ":")[1].cast("long").alias("distance"),
    )


def resolve_mapping(pairs: DataFrame, target_genes: DataFrame, query_genes: DataFrame) -> DataFrame:
    """Drop mapping rows whose genes are absent from either release."""
    t = target_genes.select("contig", F.col("gene_id").alias("target_gene_id")).distinct()
    q = query_genes.select("contig", F.col("gene_id").alias("query_gene_id")).distinct()
    return pairs.join(t, ["contig", "target_gene_id"], "left_semi").join(q, ["contig", "query_gene_id"], "left_semi")
