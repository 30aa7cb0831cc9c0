"""Transcripts of similar, not only of equal, structure.

Two lists of regions are compared place by place: a place of equal type counts the ratio of the shorter to the longer length,
any other 0, and the sum is divided by the longer list's size. At a cutoff c a partner of a list of n regions has at most n / c
regions, so all its places together lose at most b = (1 - c) n / c. Of any p > b places one therefore loses at most b / p:
it has the same type and nearly the same length. The search looks up the p longest regions of a query list at their places,
in steps of the logarithm of the length, and misses no pair. Where two lists meet, numbers that hold the types and lengths of
their first places roughly tell what these lose at least; most pairs go there. Every other one is then compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.annotation import PART, per_transcript
from annodelta.operators.skew import salted_join
from annodelta.session import cut_lineage

#: So many places are looked up that one of them loses at most this, where a list has as many.
PLACE_LOSS = 0.25
SLACK = 1e-9
#: Places whose type and length travel with the keys, two bytes each in numbers of four places, and the width of a step of the length there.
CODED = 8
CODE_BITS = 16
CODE_WIDTH = 0.1
CODES = ("code_a", "code_b")
#: Places that have so many different bits lose at least so much a bit, but for the first bit.
LOSS_OF_BIT = (1.0 - math.exp((1 - CODE_BITS) * CODE_WIDTH)) / (CODE_BITS - 1)


def region_lists(features: DataFrame, allowed_types: list[str] | None = None) -> DataFrame:
    """contig, gene_id, transcript_id, regions: (type, length) along the strand, as in the signature."""
    if allowed_types:
        features = features.where(F.col("type").isin(allowed_types))
    along = F.when(F.col("fwd"), F.col("start")).otherwise(-F.col("start"))
    op = F.struct(along.alias("along"), "ord", "type", (F.col("end") - F.col("start") + 1).cast("long").alias("length"))
    return features.groupBy(*per_transcript(features, "contig", "gene_id", "transcript_id")).agg(
        F.transform(F.sort_array(F.collect_list(op)), lambda o: F.struct(o["type"].alias("type"), o["length"].alias("length"))).alias("regions")
    ).drop(PART)


def structure_similarity(a: Column, b: Column) -> Column:
    """Similarity of two lists of regions; 0 where one is empty."""
    def place(x: Column, y: Column) -> Column:
        longer = F.greatest(x["length"], y["length"])
        ratio = F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.abs(x["length"] - y["length"]) / longer)
        return F.when(x["type"] == y["type"], ratio).otherwise(0.0)

    return F.coalesce(F.aggregate(F.zip_with(a, b, place), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.size(b)), F.lit(0.0))


def _structures(signatures: DataFrame, lists: DataFrame) -> DataFrame:
    """contig, signature, regions, id: every structure once, cut off. The list meets one transcript of each."""
    keys = ["contig", "gene_id", "transcript_id"]
    one = signatures.groupBy("contig", "signature").agg(F.min(F.struct("gene_id", "transcript_id")).alias("one")).select(
        "contig", "signature", "one.*")
    return cut_lineage(one.join(lists, keys).select("contig", "signature", "regions").withColumn("id", F.monotonically_increasing_id()))


def _place_codes(regions: Column, side: str) -> list[Column]:
    """The first places of a list as numbers; null where a length has no logarithm, which rules nothing out.

    The bits of a place go around 32 values with the step of its length, one bit changing at a time, so that two of one type
    differ in as many bits as they are steps apart (or in fewer). Types begin at different values.
    """
    around = [(1 << s) - 1 if s <= CODE_BITS else (1 << CODE_BITS) - (1 << s - CODE_BITS) for s in range(2 * CODE_BITS)]
    apiece = CODED // len(CODES)

    def code(r: Column) -> Column:
        step = F.floor(F.log(r["length"].cast("double")) / CODE_WIDTH).cast("long") + F.pmod(F.xxhash64(r["type"]), F.lit(len(around)))
        return F.element_at(F.array(*[F.lit(x).cast("long") for x in around]), (F.pmod(step, F.lit(len(around))) + 1).cast("int"))

    known = F.forall(regions, lambda r: F.coalesce((r["length"] > 0) & r["type"].isNotNull(), F.lit(False)))
    codes = F.concat(F.transform(F.slice(regions, 1, CODED), code), F.array_repeat(F.lit(0).cast("long"), CODED))
    return [F.when(known, F.aggregate(F.slice(codes, 1 + apiece * k, apiece), F.lit(0).cast("long"),
                                      lambda s, c: F.shiftleft(s, CODE_BITS).bitwiseOR(c))).alias(f"{side}_{name}")
            for k, name in enumerate(CODES)]


def _may_reach(cutoff: float) -> Column:
    """Whether the coded places of two lists of ``n`` and ``m`` regions leave them a similarity of ``cutoff``.

    Lengths d steps apart have a ratio below exp(-(d - 1) * width), and so lose at least d - 1 times LOSS_OF_BIT (for d up to
    CODE_BITS); a place of other type, or one that only one list has, loses more than that whatever its bits.
    """
    longer = F.greatest("n", "m")
    bits = sum((F.bit_count(F.col(f"t_{c}").bitwiseXOR(F.col(f"q_{c}"))) for c in CODES), F.lit(0))
    lost = (bits - F.least(longer, F.lit(CODED))) * LOSS_OF_BIT
    return F.coalesce(lost <= (1.0 - cutoff + SLACK) * longer + SLACK, F.lit(True))


def _keys(regions: Column, chosen: Column | None, width: float, steps: list[int]) -> Column:
    """(place, type, step of the length) of the ``chosen`` longest regions, or of all."""
    placed = F.transform(regions, lambda r, k: F.struct((-r["length"]).alias("short"), k.alias("place"), r["type"].alias("type")))
    if chosen is not None:
        placed = F.slice(F.sort_array(placed), 1, chosen)
    step = lambda r: F.when(r["short"] < 0, F.floor(F.log(-r["short"]) / width + SLACK)).otherwise(F.lit(-9))
    return F.flatten(F.transform(placed, lambda r: F.transform(
        F.array(*map(F.lit, steps)), lambda d: F.struct(r["place"].alias("place"), r["type"].alias("type"), (step(r) + d).alias("step")))))


def similar_signatures(
    target_signatures: DataFrame, query_signatures: DataFrame, target_features: DataFrame, query_features: DataFrame,
    cutoff: float, allowed_types: list[str] | None = None, single_by_sequence: bool = False,
    structures: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(contig, t_signature, q_signature, similarity) of all structures of one contig at or above ``cutoff``.

    Copies of a structure are not expanded: signatures name the classes. With ``single_by_sequence`` two lists of one region
    pair only if their signatures (which then carry the sequence) are equal. The cutoff is above 0.5. ``structures``
    (contig, signature, regions, id) of both sides, each once and cut off, stand in for the features where they are known.
    """
    if not 0.5 < cutoff <= 1.0:
        raise ValueError("the cutoff lies above 0.5 and is at most 1")
    t, q = (own.select("contig", *[F.col(c).alias(f"{side}_{c}") for c in ("signature", "regions", "id")]) for own, side in zip(structures or (
        _structures(signatures, region_lists(features, allowed_types))
        for signatures, features in ((target_signatures, target_features), (query_signatures, query_features))), "tq"))
    share = (1.0 - cutoff) / cutoff
    width = -math.log(1.0 - max(PLACE_LOSS, share))
    n, m = F.size("q_regions"), F.size("t_regions")
    places = F.least(n, (F.floor(n * share / PLACE_LOSS + SLACK) + 1).cast("int"))
    # A key is eight bytes, and a structure its number: two keys that meet by chance only give one more pair to compare.
    # Structures are cut off, so their keys are made anew where they are read.
    q_keys = q.select("contig", "q_id", n.alias("n"), *_place_codes(F.col("q_regions"), "q"), F.explode(
        _keys(F.col("q_regions"), places, width, [-1, 0, 1])).alias("k"))
    t_keys = t.select("contig", "t_id", m.alias("m"), *_place_codes(F.col("t_regions"), "t"), F.explode(_keys(F.col("t_regions"), None, width, [0])).alias("k"))
    met = salted_join(*(
        keys.select(F.xxhash64("contig", "k.place", "k.type", "k.step").alias("key"), *rest)
        for keys, rest in ((t_keys, ("t_id", "m", *(f"t_{c}" for c in CODES))), (q_keys, ("q_id", "n", *(f"q_{c}" for c in CODES))))
    ), ["key"]).where((F.least("n", "m") >= F.greatest("n", "m") * cutoff - SLACK)).where(_may_reach(cutoff))
    pairs = met.select("t_id", "q_id").distinct()
    compared = pairs.join(t, "t_id").join(q.withColumnRenamed("contig", "q_contig"), "q_id").where("contig = q_contig").withColumn(
        "similarity", structure_similarity(F.col("t_regions"), F.col("q_regions"))).where(F.col("similarity") >= cutoff - SLACK)
    if single_by_sequence:
        compared = compared.where("size(t_regions) > 1 or size(q_regions) > 1 or t_signature = q_signature")
    return compared.select("contig", "t_signature", "q_signature", "similarity")


def as_query_signatures(target_signatures: DataFrame, similar: DataFrame) -> DataFrame:
    """Target signatures under the names of the query signatures they are similar to; a row for each of these."""
    return target_signatures.withColumnRenamed("signature", "t_signature").join(
        similar.select("contig", "t_signature", "q_signature"), ["contig", "t_signature"]).drop("t_signature").withColumnRenamed(
        "q_signature", "signature")
