"""Text sinks. Every writer takes a DataFrame and writes a folder of part files.

Order matters only inside the files that are read by people; those are range-partitioned and
sorted, so concatenating the parts gives the sorted file and no single task holds it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.compat import Compat
from annodelta.operators.difference import ordered_report
from annodelta.operators.profile import task_totals
from annodelta.operators.signature import render_origins
from annodelta.sources.fasta_source import FastaSource, qualified, register


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", header).option("quote", "").option(
        "emptyValue", "").option("escape", "").csv(path)


def mapping_lines(pairs: DataFrame) -> DataFrame:
    """Mapping rows in file layout."""
    return pairs.select(
        "contig", F.col("query_gene_id").alias("queryId"), F.col("target_gene_id").alias("targetId"),
        F.col("query_transcript_id").alias("queryTranscriptId"),
        F.col("target_transcript_id").alias("targetTranscriptId"),
        render_origins(F.col("origins"), F.col("distance")).alias("mapping_origins"),
    )


def write_mapping(pairs: DataFrame, path: str) -> None:
    """Mapping rows behind one header line, which stands in the first part file."""
    lines = mapping_lines(pairs)
    header = pairs.sparkSession.range(1).coalesce(1).select(*[F.lit(c).alias(c) for c in lines.columns])
    write_tsv(header.unionByName(lines), path, header=False)


def write_unmapped(rows: DataFrame, path: str) -> None:
    write_tsv(rows.toDF(*C.UNMAPPED_COLUMNS), path)


def write_validation(rows: DataFrame, path: str, header: bool = False) -> None:
    """Validated pairs, equal ones first."""
    ordered = rows.select(
        F.col("target_gene_id").alias("targetGeneId"), F.col("query_gene_id").alias("queryGeneId"),
        F.col("target_transcript_id").alias("targetTranscriptId"), F.col("query_transcript_id").alias("queryTranscriptId"),
        F.col("same").cast("string").alias("same"),
    ).orderBy(F.desc("same"), "targetGeneId", "queryGeneId", "targetTranscriptId", "queryTranscriptId")
    write_tsv(ordered, path, header=header)


def write_differences(differences: DataFrame, path: str, compat: Compat = Compat(), contigs: DataFrame | None = None) -> None:
    """Report lines sorted by contig, order key and text, a header line first.

    ``contigs`` (contig, first: where it first appears) gives their order; contigs it lacks follow by name.
    """
    lines = ordered_report(differences, compat)
    placed = lines.join(contigs, "contig", "left") if contigs is not None else lines.withColumn("first", F.lit(None).cast("int"))
    header = differences.sparkSession.range(1).select(F.lit("\t".join(C.DIFFERENCE_COLUMNS)).alias("line"), F.lit(0).alias("part"))
    ordered = placed.withColumn("part", F.lit(1)).unionByName(header, allowMissingColumns=True).orderBy(
        "part", F.asc_nulls_last("first"), "contig", "order_key", "line")
    ordered.select("line").write.mode("overwrite").text(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    """Records (transcript_id, sequence) by id in few files, each with its index; ``read_genome`` takes the folder."""
    register(sequences.sparkSession)
    records = sequences.select("transcript_id", "sequence").repartitionByRange("transcript_id").sortWithinPartitions("transcript_id")
    records.write.format(FastaSource.name()).mode("overwrite").save(qualified(sequences.sparkSession, path))


def write_overall_time(spark: SparkSession, milliseconds: int, path: str) -> None:
    """How long a mapping took, beside its result."""
    spark.createDataFrame([(str(milliseconds),)], "value string").write.mode("overwrite").text(path + ".overall_time")


def write_stage_times(spark: SparkSession, stages: list[tuple[str, int]], path: str) -> None:
    """Milliseconds of every named task, repeated ones summed."""
    log = spark.createDataFrame(stages, "task string, millis long")
    write_tsv(task_totals(log).select(F.col("task").alias("Task Name"), F.col("millis").alias("Milliseconds")).orderBy("Task Name"),
              path + ".time_eval")
