"""Following ids through their recorded changes between releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.session import cut_lineage


def id_changes(history: DataFrame, last_release: float) -> DataFrame:
    """Changes of id (old_id, new_id, new_release) up to a release; retired ids have no new id."""
    return history.where(
        (F.col("new_release") <= last_release) & (F.col("new_release") >= F.col("old_release"))
        & (F.col("new_id") != "") & (F.col("old_id") != F.col("new_id"))
    ).groupBy("old_id", "new_id").agg(F.max("new_release").alias("new_release"))


def retired_ids(history: DataFrame, last_release: float) -> DataFrame:
    """Ids recorded as ending without successor by a release."""
    return history.where((F.coalesce("new_id", F.lit("")) == "") & (F.col("new_release") <= last_release)).select(
        F.col("old_id").alias("id")
    ).distinct()


def successors(history: DataFrame, first_release: float, last_release: float) -> DataFrame:
    """(id, successor): every living id reachable from the ids known at ``first_release``.

    Breadth first: a round extends only the pairs that were new in the round before, so the number
    of rounds is the length of the longest chain of changes.
    """
    changes = cut_lineage(id_changes(history, last_release).select("old_id", "new_id"))
    starts = history.where(F.col("old_release") <= first_release).select(F.col("old_id").alias("id")).distinct()
    frontier = cut_lineage(
        starts.join(changes, F.col("id") == F.col("old_id")).select("id", F.col("new_id").alias("successor")).distinct()
    )
    known = frontier
    while not frontier.isEmpty():
        frontier = cut_lineage(
            frontier.join(changes, F.col("successor") == F.col("old_id"))
            .select("id", F.col("new_id").alias("successor")).distinct()
            .join(known, ["id", "successor"], "left_anti")
        )
        known = known.unionByName(frontier)
    return known.join(
        retired_ids(history, last_release).withColumnRenamed("id", "successor"), "successor", "left_anti"
    ).select("id", "successor")
