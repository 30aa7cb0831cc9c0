"""Bit votes of 64-bit term hashes, summed with built-in aggregates only.

A sum over 64 separate bits would need 64 buffers. Here each long carries four counters of 16 bits, so that 16 sums
do; a piece of a document holds so few terms that no counter overflows, and pieces are added up in counters of 32 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTER_MAX = 32_767
_NARROW = 0x0001000100010001
_WIDE = 0x0000FFFF0000FFFF


def sign_bits(terms: DataFrame, keys: list[str], place: str, hashed: str, weight: str | None = None,
              max_weight: int = 1) -> DataFrame:
    """keys + ``fingerprint`` (long): a bit is one if it is set in over half the weight of the hashes.

    ``place`` counts the terms of a document; a null hash votes for nothing, and without votes the result is zero.
    """
    votes = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    votes = F.when(F.col(hashed).isNull(), F.lit(0).cast("long")).otherwise(votes)
    value = F.coalesce(F.col(hashed), F.lit(0).cast("long"))
    pieces = terms.select(
        *keys, F.expr(f"{place} div {COUNTER_MAX // max_weight}").alias("_piece"), value.alias("_h"), votes.alias("_w")
    ).groupBy(*keys, "_piece").agg(
        F.sum("_w").alias("_all"),
        *(F.sum(F.shiftright("_h", j).bitwiseAND(F.lit(_NARROW)) * F.col("_w")).alias(f"_n{j}") for j in range(16)),
    )
    wide = [
        F.sum(F.shiftrightunsigned(f"_n{j}", shift).bitwiseAND(F.lit(_WIDE))).alias(f"_s{j}_{odd}")
        for j in range(16) for odd, shift in ((0, 0), (1, 16))
    ]
    summed = pieces.groupBy(*keys).agg(F.sum("_all").alias("_all"), *wide)
    return summed.select(*keys, _assemble().alias("fingerprint"))


def _assemble() -> Column:
    bits = []
    for bit in range(64):
        lane, j = divmod(bit, 16)
        pair = F.col(f"_s{j}_{lane % 2}")
        count = F.shiftrightunsigned(pair, 32) if lane >= 2 else pair.bitwiseAND(F.lit(0xFFFFFFFF))
        value = 1 << bit if bit < 63 else -(1 << 63)
        bits.append(F.when(count * 2 > F.col("_all"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
