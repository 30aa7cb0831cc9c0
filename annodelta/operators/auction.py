"""Exact matching of components too large for one task, as rounds of bids over a table of scored pairs.

The pairs are doubled into a problem in which everybody gets a partner: a second copy of all pairs with the sides swapped,
and a pair of weight 0 between the two copies of each name, which stands for staying alone. The best total of the
doubled problem is twice that of the first copy, so the first copy's share of the result is a best matching.

In a round every open bidder offers for the object worth most to it at the current prices, raising its price to the point
where its second choice would be as good, plus a step; the best offer for an object wins and its former owner is open
again. The step shrinks by phases: a phase starts from the prices and from the owners that are still content. Weights are
integers times (bidders + 1), so at a step of 1 the result is a best one, and tie values make that the only one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annodelta.functions.assignment import TIE_BITS
from annodelta.session import cut_lineage

#: The step is divided by this from phase to phase.
SHRINK = 16
WHOLE = "decimal(38,0)"


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast(WHOLE)


def _doubled(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(bidder, object, weight) of the doubled problem, and how many bidders it has."""
    def name(side: str, column: str) -> Column:
        return F.concat_ws("\t", F.lit(side), "contig", column)

    t, q = "target_transcript_id", "query_transcript_id"
    names = pairs.select(name("t", t).alias("n")).union(pairs.select(name("q", q).alias("n"))).distinct()
    size = names.count()
    tie = F.conv(F.substring(F.md5(F.concat_ws("\t", t, q)), 1, TIE_BITS // 4), 16, 10)
    bits = TIE_BITS + size.bit_length()
    weight = ((F.col("units").cast(WHOLE) * _whole(1 << bits)).cast(WHOLE) + tie.cast(WHOLE)).cast(WHOLE)
    weighted = pairs.select(name("t", t).alias("t"), name("q", q).alias("q"), (weight * _whole(size + 1)).cast(WHOLE).alias("w"))
    alone = names.where("n like 't%'").select("n", F.concat(F.lit("copy\t"), "n"), _whole(0)).union(
        names.where("n like 'q%'").select(F.concat(F.lit("copy\t"), "n"), "n", _whole(0)))
    return weighted.union(weighted.select(F.concat(F.lit("copy\t"), "q"), F.concat(F.lit("copy\t"), "t"), "w")).union(
        alone).toDF("bidder", "object", "weight"), size


def match_exactly(pairs: DataFrame) -> DataFrame:
    """The best one-to-one subset of ``pairs`` (contig, target_transcript_id, query_transcript_id, units > 0, …).

    Largest total of ``units``, then of tie values, as :func:`annodelta.functions.assignment.unique_assignment`.
    """
    pairs = cut_lineage(pairs)
    edges, size = _doubled(pairs)
    edges = cut_lineage(edges)
    highest = edges.agg(F.max("weight")).first()[0]
    state = cut_lineage(edges.select("object").distinct().select("object", _whole(0).alias("price"), F.lit(None).cast("string").alias("owner")))
    step = max(1, int(highest or 0) // 4)
    while size:
        state = _content(edges, state, step)
        while state.where("owner is null").count():
            state = _round(edges, state, step)
        if step == 1:
            break
        step = max(1, step // SHRINK)
    chosen = state.select(F.split("object", "\t").alias("o"), F.split("owner", "\t").alias("b")).where("o[0] = 'q' and b[0] = 't'")
    keys = [F.element_at("o", 2).alias("contig"), F.element_at("b", 3).alias("target_transcript_id"),
            F.element_at("o", 3).alias("query_transcript_id")]
    return pairs.join(chosen.select(*keys), ["contig", "target_transcript_id", "query_transcript_id"], "left_semi")


def _content(edges: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """``state`` without the owners to whom another object would be worth more than their own by over ``step``."""
    worth = edges.join(state, "object").withColumn("worth", (F.col("weight") - F.col("price")).cast(WHOLE))
    unhappy = worth.groupBy("bidder").agg(
        F.max("worth").alias("best"), F.max(F.when(F.col("owner") == F.col("bidder"), F.col("worth"))).alias("own")
    ).where(F.col("own") < F.col("best") - _whole(step)).select(F.col("bidder").alias("owner"), F.lit(True).alias("leaves"))
    return cut_lineage(state.join(unhappy, "owner", "left").select(
        "object", "price", F.when(F.col("leaves"), None).otherwise(F.col("owner")).alias("owner")))


def _round(edges: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """``state`` after every open bidder has made an offer. Each has two objects at least."""
    owners = state.where("owner is not null").select(F.col("owner").alias("bidder"))
    choice = Window.partitionBy("bidder").orderBy(F.desc("worth"), "object")
    ranked = edges.join(owners, "bidder", "left_anti").join(state.select("object", "price"), "object").withColumn(
        "worth", (F.col("weight") - F.col("price")).cast(WHOLE)).withColumn("rank", F.row_number().over(choice)).where("rank <= 2")
    first = F.col("rank") == 1
    bids = ranked.groupBy("bidder").agg(
        F.max(F.when(first, F.col("object"))).alias("object"), F.max(F.when(first, F.col("weight"))).alias("weight"),
        F.min("worth").alias("second"))
    # The price at which the first choice is worth as much as the second one, and a step more.
    offers = bids.select("bidder", "object", (F.col("weight") - F.col("second") + _whole(step)).cast(WHOLE).alias("offer"))
    won = offers.groupBy("object").agg(F.max(F.struct("offer", "bidder")).alias("w"))
    return cut_lineage(state.join(won, "object", "left").select(
        "object", F.coalesce("w.offer", "price").alias("price"), F.coalesce("w.bidder", "owner").alias("owner")))
