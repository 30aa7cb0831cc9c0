"""Readers of the smaller text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.functions.text import parse_sam


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping file rows; the header and rows without exactly six fields are dropped."""
    field = F.split("value", "\t")
    return (
        spark.read.text(path)
        .where((F.size(field) == len(C.MAPPING_COLUMNS)) & ~F.col("value").startswith("contig\tqueryId"))
        .select(*[field[i].alias(c) for i, c in enumerate(C.MAPPING_COLUMNS)])
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def read_id_history(spark: SparkSession, path: str) -> DataFrame:
    """Historic id changes: session, old id and version, new id and version, old and new release."""
    return spark.read.schema(
        "session int, old_id string, new_id string, old_version int, new_version int, "
        "unused1 string, unused2 string, old_release float, new_release float"
    ).csv(path, sep="\t", mode="DROPMALFORMED").drop("unused1", "unused2")


def read_profile_events(spark: SparkSession, path: str) -> DataFrame:
    """Profiler events exported as JSON lines: kind, ts, frames (innermost first), bytes."""
    return spark.read.schema("kind string, ts timestamp, frames array<string>, bytes long, recording string").json(path)
