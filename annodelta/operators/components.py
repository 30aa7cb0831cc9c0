"""Connected components of any links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.session import cut_lineage


def linked_components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (columns a, b of one orderable type); the root is a component's smallest node.

    Every node points to the smallest node it knows. A round offers to each node the pointers of its neighbours, and then
    to each pointer's own pointer, which halves the depth of the trees; the rounds needed grow with the logarithm of a component's
    longest way. Offers are minima, so they are combined before the shuffle however many links a node has.
    """
    both = cut_lineage(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    state = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")))
    while True:
        offers = both.join(state, F.col("b") == F.col("node")).select(F.col("a").alias("to"), "root")
        # What a neighbour offers also holds for the node this one points to.
        hooked = offers.join(state.select(F.col("node").alias("to"), F.col("root").alias("up")), "to").select(
            F.col("up").alias("to"), "root")
        least = offers.union(hooked).groupBy("to").agg(F.min("root").alias("least"))
        lower = state.join(least, F.col("node") == F.col("to"), "left").select(
            "node", F.least("root", "least").alias("up"), F.col("root").alias("before"))
        above = lower.select(F.col("node").alias("above"), F.col("up").alias("top"))
        moved = cut_lineage(lower.join(above, F.col("up") == F.col("above"), "left").select(
            "node", F.least("up", "top").alias("root"), "before"))
        settled = moved.where("root <> before").isEmpty()
        state = moved.select("node", "root")
        if settled:
            return state
