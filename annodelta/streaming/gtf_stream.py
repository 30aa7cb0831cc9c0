"""Following a folder of annotation files: the same line parser on a streaming read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta.sources.gtf import parse_lines


def stream_gtf_lines(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """GTF rows of every file that appears in ``folder``, with the file name."""
    lines = (
        spark.readStream.option("pathGlobFilter", "*.[gG][tT][fF]").option("maxFilesPerTrigger", max_files).text(folder)
        .select("value", F.col("_metadata.file_name").alias("file"))
    )
    return parse_lines(lines)
