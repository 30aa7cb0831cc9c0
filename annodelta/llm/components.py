"""Connected components of links by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b, of one orderable type); root: the smallest node reachable.

    Each round every node hangs its larger neighbours under the smallest node it knows, then its smaller ones; the rounds
    needed grow with the logarithm of a component's size. A node with very many links is summed before the shuffle, and
    its join is split by adaptive execution. Every round is written to the checkpoint folder.
    """
    edges = cut_lineage(_ordered(links))
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))  # a is the larger end
        moved = large.join(lowest, "a")
        edges = cut_lineage(_ordered(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            moved.select("a", F.col("m").alias("b")))))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links between different nodes, the larger node first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
