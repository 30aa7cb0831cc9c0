"""Genome text as a table of fixed-size chunks, and fetching spans from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.functions.sequence import reverse_complement_upper

CHUNK_BASES = 8192


def chunk_sequences(sequences: DataFrame, chunk: int = CHUNK_BASES) -> DataFrame:
    """(contig, chunk_id, chunk_start, seq) from whole sequences (contig, seq)."""
    cut = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk_id", "seq")
    return sequences.where(F.length("seq") > 0).select("contig", cut).select(
        "contig", F.col("chunk_id").cast("long").alias("chunk_id"),
        (F.col("chunk_id").cast("long") * chunk + 1).alias("chunk_start"), "seq",
    )


def fetch_spans(spans: DataFrame, genome: DataFrame, keys: list[str], chunk: int = CHUNK_BASES) -> DataFrame:
    """``spans`` with the ``sequence`` of [start, end]; null where the genome does not cover it.

    ``keys`` (with contig) identify a span. Only the chunks a span touches are joined, cut to the
    part it needs, and put together in order.
    """
    touched = F.sequence(F.expr(f"(start - 1) div {chunk}"), F.expr(f"(end - 1) div {chunk}"))
    wanted = spans.where((F.col("start") >= 1) & (F.col("end") >= F.col("start"))).select(
        "contig", *keys, "start", "end", F.explode(touched).alias("chunk_id")
    )
    first = F.greatest(F.col("start"), F.col("chunk_start"))
    last = F.least(F.col("end"), F.col("chunk_start") + F.length("seq") - 1)
    pieces = wanted.join(genome, ["contig", "chunk_id"]).select(
        "contig", *keys, "start", "end", "chunk_id",
        F.substring("seq", (first - F.col("chunk_start") + 1).cast("int"), (last - first + 1).cast("int")).alias("piece"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("chunk_id", "piece")))
    whole = pieces.groupBy("contig", *keys, "start", "end").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("sequence")
    ).where(F.length("sequence") == F.col("end") - F.col("start") + 1)
    return spans.join(whole, ["contig", *keys, "start", "end"], "left")


def on_strand(sequence: Column, forward: Column) -> Column:
    """The sequence as read on its strand."""
    return F.when(forward, sequence).otherwise(reverse_complement_upper(sequence))


def spliced_sequences(features: DataFrame, genome: DataFrame, prefer_coding: bool = False, chunk: int = CHUNK_BASES) -> DataFrame:
    """(contig, gene_id, transcript_id, sequence): regions of a transcript joined for alignment.

    Regions follow the strand and the joined text of a reverse-strand transcript is then reverse
    complemented as a whole, so its pieces appear in genomic order. ``prefer_coding`` takes the
    coding regions of transcripts that have some. A transcript with a region beyond the genome has
    a null sequence, never one put together from the rest.
    """
    kinds = ["exon", "CDS"] if prefer_coding else ["exon"]
    regions = features.where(F.col("type").isin(kinds)).select(
        "contig", "gene_id", "transcript_id", "type", "fwd", "ord", "start", "end"
    )
    keys = ["gene_id", "transcript_id", "type", "fwd", "ord"]
    fetched = fetch_spans(regions, genome, keys, chunk)
    along = F.when(F.col("fwd"), F.col("start")).otherwise(-F.col("start"))
    parts = F.transform(
        F.sort_array(F.collect_list(F.struct(along.alias("at"), F.col("ord"), F.col("sequence")))), lambda x: x["sequence"]
    )
    joined = fetched.groupBy("contig", "gene_id", "transcript_id", "fwd").pivot("type", kinds).agg(
        F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, "")).alias("text")
    )
    text = F.col("exon")
    if prefer_coding:
        text = F.when(F.coalesce(F.length("CDS"), F.lit(1)) > 0, F.col("CDS")).otherwise(text)
    return joined.select("contig", "gene_id", "transcript_id", on_strand(text, F.col("fwd")).alias("sequence"))


def compare_spans(pairs: DataFrame, target_genome: DataFrame, query_genome: DataFrame, keys: list[str], chunk: int = CHUNK_BASES) -> DataFrame:
    """``pairs`` (contig, keys, t_start, t_end, q_start, q_end) with ``t_sequence`` and ``q_sequence``."""
    def side(p: str, genome: DataFrame) -> DataFrame:
        spans = pairs.select("contig", *keys, F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"))
        return fetch_spans(spans, genome, keys, chunk).select("contig", *keys, F.col("sequence").alias(f"{p}_sequence"))

    return pairs.join(side("t", target_genome), ["contig", *keys]).join(side("q", query_genome), ["contig", *keys])
