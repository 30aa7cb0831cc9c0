"""Reading indexed FASTA files into the chunked genome table.

The index gives the byte position of every contig, so a file is cut into ranges that tasks read
independently; no task sees more than its ranges. Block-compressed files (BGZF) are cut at their
compression blocks instead. The data sources behind it are in ``fasta_source``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annodelta.operators.genome import CHUNK_BASES
from annodelta.session import cut_lineage
from annodelta.sources.fasta_source import (
    BGZF_HEADER,
    BGZF_MARKS,
    BLOCK_BYTES,
    BLOCKS_PER_RUN,
    PUSHDOWN,
    SPLIT_BYTES,
    BlockSource,
    FastaSource,
    block_length,
    locate,
    open_file,
    qualified,
    register,
)

RANGES_PER_GROUP = 1024


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bases, offset, line_bases, line_width) of a FASTA index."""
    return spark.read.schema(
        "contig string, bases long, offset long, line_bases long, line_width long"
    ).csv(path, sep="\t", mode="DROPMALFORMED")


def is_block_compressed(path: str) -> bool:
    filesystem, name = locate(path)
    if filesystem.get_file_info(name).type == pafs.FileType.Directory:
        return False
    with filesystem.open_input_file(name) as handle:
        return handle.read(4) == BGZF_MARKS[0][1]


def read_genome(
    spark: SparkSession, fasta: str, fai: str | None = None, chunk: int = CHUNK_BASES, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Chunked genome (contig, chunk_id, chunk_start, seq) of an indexed FASTA file, or of a folder of plain ones."""
    register(spark)
    fasta, fai = qualified(spark, fasta), fai and qualified(spark, fai)
    if is_block_compressed(fasta):
        return _from_blocks(spark, fasta, read_fai(spark, fai or fasta + ".fai"), chunk, split_bytes)
    return spark.read.format(FastaSource.name()).options(
        path=fasta, fai=fai or "", chunk=chunk, splitBytes=split_bytes, pushdown=spark.conf.get(PUSHDOWN, "false")).load()


def block_runs(spark: SparkSession, fasta: str, split_bytes: int) -> DataFrame:
    """(at, plain, blocks): where runs of blocks begin in the file and in its text.

    Every byte range lists its own blocks. What lies before a range is summed in groups of ranges, then over the groups.
    """
    ranges = cut_lineage(spark.read.format(BlockSource.name()).options(path=fasta, splitBytes=split_bytes).load()).withColumn(
        "group", F.expr(f"number div {RANGES_PER_GROUP}"))
    before = (Window.unboundedPreceding, -1)
    groups = ranges.groupBy("group").agg(F.sum("text_bytes").alias("group_bytes"))
    across = Window.orderBy("group").rowsBetween(*before)  # a row for every 16 GB of file
    groups = groups.select("group", F.coalesce(F.sum("group_bytes").over(across), F.lit(0)).alias("group_start"))
    inside = Window.partitionBy("group").orderBy("number").rowsBetween(*before)
    placed = ranges.withColumn("start", F.coalesce(F.sum("text_bytes").over(inside), F.lit(0))).join(groups, "group")
    return placed.select("group_start", "start", F.explode("runs").alias("run")).select(
        "run.at", (F.col("group_start") + F.col("start") + F.col("run.inner")).alias("plain"), "run.blocks")


def _from_blocks(spark: SparkSession, fasta: str, index: DataFrame, chunk: int, split_bytes: int) -> DataFrame:
    """Blocks are found by byte ranges and decompressed on all tasks, a run of blocks a row."""
    def inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open_file(fasta) as handle:
            for batch in batches:
                for at, plain, blocks in zip(batch["at"], batch["plain"], batch["blocks"]):
                    handle.seek(int(at))
                    parts = []
                    for _ in range(int(blocks)):
                        header = handle.read(BGZF_HEADER)
                        body = handle.read(block_length(header, 0) - BGZF_HEADER)
                        parts.append(zlib.decompress(body[:-8], wbits=-15))
                        if zlib.crc32(parts[-1]) != struct.unpack_from("<I", body, len(body) - 8)[0]:
                            raise ValueError(f"damaged block in the run at byte {at}")
                    text = b"".join(parts)
                    yield pd.DataFrame({"plain": [plain], "plain_end": [plain + len(text)], "text": [text.decode("ascii")]})

    texts = block_runs(spark, fasta, split_bytes).repartition("at").mapInPandas(inflate, "plain long, plain_end long, text string")
    # A run of blocks covers at most 4 MiB of text: place both sides on a grid of that size.
    grid = BLOCKS_PER_RUN * BLOCK_BYTES
    contigs = index.where("bases > 0").withColumn(
        "stop", F.expr("offset + ((bases - 1) div line_bases) * line_width + (bases - 1) % line_bases + 1")
    )
    cell = F.explode(F.expr(f"sequence(offset div {grid}, (stop - 1) div {grid})")).alias("cell")
    placed = texts.where("plain_end > plain").withColumn(
        "cell", F.explode(F.expr(f"sequence(plain div {grid}, (plain_end - 1) div {grid})"))
    ).join(contigs.select("*", cell), "cell").where(
        (F.col("plain") < F.col("stop")) & (F.col("offset") < F.col("plain_end"))
        & (F.col("cell") == F.expr(f"greatest(plain, offset) div {grid}"))
    )
    first = F.greatest("plain", "offset")
    last = F.least("plain_end", "stop")
    pieces = placed.select(
        "contig",
        F.expr(
            "((greatest(plain, offset) - offset) div line_width) * line_bases"
            " + least((greatest(plain, offset) - offset) % line_width, line_bases)"
        ).alias("base"),
        F.regexp_replace(
            F.substring("text", (first - F.col("plain") + 1).cast("int"), (last - first).cast("int")), "[\r\n]", ""
        ).alias("bases"),
    ).where(F.length("bases") > 0)
    cut = pieces.withColumn(
        "chunk_id", F.explode(F.expr(f"sequence(base div {chunk}, (base + length(bases) - 1) div {chunk})"))
    ).select(
        "contig", "chunk_id", "base",
        F.expr(f"substring(bases, cast(greatest(chunk_id * {chunk} - base, 0) + 1 as int),"
               f" cast(least((chunk_id + 1) * {chunk}, base + length(bases)) - greatest(chunk_id * {chunk}, base) as int))").alias("part"),
    )
    return cut.groupBy("contig", "chunk_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "part"))), lambda x: x["part"]), "").alias("seq")
    ).select("contig", "chunk_id", (F.col("chunk_id") * chunk + 1).alias("chunk_start"), "seq")
