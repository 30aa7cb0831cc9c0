"""The row that follows each row in ascending order of an id, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SUPER = 65_536


def with_next(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``rows`` with ``_block``, ``_rank`` (unique in the block) and ``_next``, a struct of the next row's ``payload``.

    Order: ``key`` ascending, null last, then the payload. After the last row comes the first; a single row follows itself.
    Ids are cut into blocks of 256 values, so a block holds few rows and ids need not be dense.
    The first row of a block travels to the block before it; blocks themselves are linked in blocks of blocks.
    """
    blocked = rows.withColumn("_block", F.coalesce(F.expr(f"`{key}` div {BLOCK}"), F.lit((1 << 62))))
    inside = Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_last(), *(F.col(c) for c in payload if c != key))
    linked = blocked.withColumn("_rank", F.row_number().over(inside)).withColumn(
        "_inner", F.lead(F.struct(*payload)).over(inside))
    heads = linked.where(F.col("_rank") == 1).select("_block", F.struct(*payload).alias("_head"))
    edges = heads.join(_previous(blocked), "_block").select(F.col("_before").alias("_block"), "_head")
    return linked.join(edges, "_block").select(
        "*", F.coalesce("_inner", "_head").alias("_next")).drop("_inner", "_head")


def _previous(blocked: DataFrame) -> DataFrame:
    """_block, _before: the block before it, and for the first one the last."""
    blocks = blocked.groupBy("_block").agg(F.expr(f"_block div {SUPER}").alias("_super"))
    groups = blocks.groupBy("_super").agg(F.max("_block").alias("_last"))
    by_super = Window.orderBy("_super")  # a row per 16 million id values
    whole = by_super.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("_super", F.coalesce(F.lag("_last").over(by_super), F.max("_last").over(whole)).alias("_wrap"))
    inside = Window.partitionBy("_super").orderBy("_block")
    return blocks.withColumn("_lag", F.lag("_block").over(inside)).join(groups, "_super").select(
        "_block", F.coalesce("_lag", "_wrap").alias("_before"))
