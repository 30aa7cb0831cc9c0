"""Fuzzy line dedup by MinHash over character shingles; one line per class of near-equal lines stays.

DataFrame functions only. Lines are keyed by two hashes of their text. A line's shingles (``SHINGLE`` characters, from
every position) are hashed once each, and the minimum under sixteen exclusive-or permutations of the hash is its
signature. Bands of four minima put lines into buckets; in a bucket every line is compared with the first one. Buckets that
this leaves in several components are open: all their other lines are joined exactly, by a prefix filter that loses no pair. Two
sets of a and b shingles that are similar enough share 4/9 (a + b) of them, so in an order common to all lines (rarest
first) they meet within the first (5a - 4b)/9 + 1 and (5b - 4a)/9 + 1. What a template shares stands behind these, and 512
parity bits of each line's shingles turn down, inside the join, pairs that differ in more than (a + b)/9 bits. Of the pairs
left, one for every two classes is compared first; the others only if that did not join their classes. Compared lines are linked if the exact Jaccard similarity of their shingle sets is 0.8 or more. Classes are connected
components of links and of equality; the first line of a class (least doc_id, then line number) stays.

Defined cases: null text has no lines to remove; lines without a word are left alone and belong to no class; lines
shorter than a shingle are one shingle, so only equal ones match; rows with equal doc_id count as one document whose
lines come in the order of line numbers, and equal rows stay equal; rows with a null doc_id are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.components import components
from annodelta.llm.text import ASCII_SPACE, whole_text
from annodelta.session import cut_lineage

SHINGLE = 8
MINIMA, BANDS, BAND_ROWS = 16, 8, 4
#: Similarity as a fraction of integers.
NEAR = (4, 5)
#: Lines with one shingle that meet in one cell of the exact join.
CELL_LINES = 1_000
#: Words of 64 bits in a line's parity bits.
PARITY_WORDS = 8


def _pattern(k: int) -> int:
    """The k-th exclusive-or pattern: evenly spread in the leading bits, mixed below."""
    mixed = (k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 59) - 1)
    value = (k << 60) | mixed
    return value - (1 << 64) if value >= 1 << 63 else value


def _band_rows(band: int) -> list[int]:
    """Minima of a band; neighbouring bands share some."""
    return sorted({(2 * band + step) % MINIMA for step in (0, 1, 5, 10)})


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line, k1, k2 of all lines with a word."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(whole_text(), "\n")).alias("no", "line"))
    return lines.where(F.btrim("line", F.lit(ASCII_SPACE)) != "").select(
        "doc_id", "no", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2"))


def _positions(code: Column) -> Column:
    """0-based starts of the shingles of a line in two-byte characters."""
    return F.sequence(F.lit(0), F.greatest(F.expr("octet_length(_code) div 2") - SHINGLE, F.lit(0)))


def signatures(lines: DataFrame) -> DataFrame:
    """k1, k2, n (occurrences' shingles), m0...: the minima of every distinct line."""
    code = F.encode("line", "UTF-16BE")
    exploded = lines.select("k1", "k2", code.alias("_code")).select(
        "k1", "k2", "_code", F.explode(_positions(F.col("_code"))).alias("_at"))
    hashed = exploded.select("k1", "k2", F.xxhash64(F.substring(F.col("_code"), F.col("_at") * 2 + 1, F.lit(2 * SHINGLE))).alias("_h"))
    return hashed.groupBy("k1", "k2").agg(
        *(F.min(F.shiftright(F.col("_h").bitwiseXOR(F.lit(_pattern(k))), 32).cast("int")).alias(f"m{k}")
          for k in range(MINIMA)))


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): first keys k1 of the first line of a bucket and of each other line there.

    Rows carry one of the two keys; lines that share it by chance are told apart by their texts later.
    """
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"m{k}" for k in _band_rows(b))) for b in range(BANDS)))
    banded = signed.select(F.col("k1").alias("b"), F.explode(bands).alias("_band"))
    first = banded.groupBy("_band").agg(F.min("b").alias("a"), F.max("b").alias("_last")).where("a < _last")
    return banded.join(first.drop("_last"), "_band").where("a < b").select("a", "b").distinct()


def open_lines(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """k1 of the lines in buckets of which not every pair is settled; ``rooted``: k1, root.

    The first line of a bucket is compared with each of the others, so only these others can still be apart.
    """
    others = pairs.join(rooted.select(F.col("k1").alias("b"), "root"), "b")
    apart = others.groupBy("a").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most")
    return pairs.join(apart.select("a"), "a", "left_semi").select(F.col("b").alias("k1")).distinct()


def parity_bits(shingled: DataFrame) -> DataFrame:
    """k1, k2, bits (a struct of words): per bit, whether an odd number of the line's shingles fall on it; ``shingled``: k1, k2, h.

    Each bit in which two lines differ needs a shingle of its own that only one of them has. So the differing bits never
    exceed the shingles that are not shared, and a pair with too many of them cannot be near enough.
    """
    words = (F.bit_xor(F.expr(f"if(h & {PARITY_WORDS - 1} = {w}, shiftleft(1L, cast(shiftright(h, 32) & 63 as int)), 0L)"))
             .alias(f"w{w}") for w in range(PARITY_WORDS))
    return shingled.groupBy("k1", "k2").agg(*words).select(
        "k1", "k2", F.struct(*(f"w{w}" for w in range(PARITY_WORDS))).alias("bits"))


def prefix_pairs(rooted: DataFrame) -> DataFrame:
    """a, b, ra, rb, differing: first keys of all lines of ``rooted`` (k1, k2, line, root) of different roots that may be near enough.

    ra and rb are hashes of their roots, differing counts unequal parity bits. The parity bits travel with the prefix, so that the join itself turns down what shares a prefix by its template only.
    """
    keys = ["k1", "k2"]
    shingled = rooted.select(*keys, _shingle_set("line").alias("_set")).select(
        *keys, F.size("_set").alias("n"), F.explode("_set").alias("h"))
    times = shingled.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    # The shingles of one line only come first in the order; they take places but meet nothing.
    met = shingled.join(times, "h").groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("_met"))
    alone = F.col("n") - F.size("_met")
    wide = F.expr(f"n div {NEAR[1]}") + 1 - alone
    named = rooted.select(*keys, F.xxhash64("root").alias("root")).join(parity_bits(shingled), keys)
    placed = cut_lineage(met.where(wide > 0).select(*keys, "n", alone.alias("_alone"), F.slice("_met", F.lit(1), wide).alias("_met")).join(
        named, keys))

    def entries(side: str) -> DataFrame:
        """h, cells and a struct named ``side`` for each place in a line's prefix."""
        return placed.select(*keys, "n", "root", "bits", "_alone", F.posexplode("_met").alias("_at", "_x")).select(
            F.col("_x.h").alias("h"), F.ceil(F.col("_x.times") / CELL_LINES).cast("int").alias("cells"),
            F.struct("n", *keys, "root", (F.col("_at") + F.col("_alone")).alias("at"), "bits").alias(side))

    total = NEAR[0] + NEAR[1]
    # The smaller line of a pair never needs more than a ninth of its shingles.
    small = entries("x").where(F.col("x.at") * total <= F.col("x.n")).select(
        "h", F.pmod(F.xxhash64("x.k1", "x.k2"), "cells").cast("int").alias("cell"), "x")
    large = entries("y").select("h", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "y")
    reach = [(F.col(f"{own}.at") * total <= F.col(f"{own}.n") * NEAR[1] - F.col(f"{other}.n") * NEAR[0])
             for own, other in (("x", "y"), ("y", "x"))]
    differing = sum((F.bit_count(F.col(f"x.bits.w{w}").bitwiseXOR(F.col(f"y.bits.w{w}"))) for w in range(PARITY_WORDS)), F.lit(0))
    near = differing * total <= (F.col("x.n") + F.col("y.n")) * (NEAR[1] - NEAR[0])
    before = F.struct("x.n", "x.k1", "x.k2") < F.struct("y.n", "y.k1", "y.k2")
    found = small.join(large, ["h", "cell"]).where((F.col("x.root") != F.col("y.root")) & reach[0] & reach[1] & near & before)
    turned = F.col("x.k1") > F.col("y.k1")
    return found.select(
        F.when(turned, F.col("y.k1")).otherwise(F.col("x.k1")).alias("a"), F.when(turned, F.col("x.k1")).otherwise(F.col("y.k1")).alias("b"),
        F.when(turned, F.col("y.root")).otherwise(F.col("x.root")).alias("ra"),
        F.when(turned, F.col("x.root")).otherwise(F.col("y.root")).alias("rb"), differing.alias("differing")).distinct()


def _shingle_set(line: str) -> Column:
    def of(code: Column) -> Column:  # a variable, so that the line is encoded once and not once per shingle
        last = F.greatest((F.octet_length(code) / 2).cast("int") - SHINGLE, F.lit(0))
        return F.array_distinct(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(code, i * 2 + 1, F.lit(2 * SHINGLE)))))

    return F.element_at(F.transform(F.array(F.encode(line, "UTF-16BE")), of), 1)


def line_texts(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """k1, k2, line of the lines in ``pairs``."""
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    found = lines.select("k1", "k2", "line").join(wanted, F.col("k1") == F.col("w"), "left_semi")
    return cut_lineage(found.dropDuplicates(["k1", "k2"]))


def verified_links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): node names of the pairs whose exact Jaccard similarity is enough."""
    left = texts.select(F.col("k1").alias("a"), _node("k1", "k2").alias("_na"), F.col("line").alias("_a"))
    right = texts.select(F.col("k1").alias("b"), _node("k1", "k2").alias("_nb"), F.col("line").alias("_b"))
    sets = F.array(F.struct(_shingle_set("_a").alias("x"), _shingle_set("_b").alias("y")))

    def near(z: Column) -> Column:  # the struct holds the sets, so that each is built once
        shared = F.size(F.array_intersect(z["x"], z["y"]))
        return shared * (NEAR[0] + NEAR[1]) >= (F.size(z["x"]) + F.size(z["y"])) * NEAR[0]

    return pairs.join(left, "a").join(right, "b").where(F.exists(sets, near)).select(F.col("_na").alias("a"), F.col("_nb").alias("b"))


def root_links(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): the roots of both ends of ``links`` (node names); ``rooted``: node, root."""
    roots = rooted.select("node", "root")
    return links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def joined_roots(texts: DataFrame, rooted: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root): roots that the pairs of ``found`` join, under the smallest root of each new class.

    For every two roots the most promising pair is compared first. Pairs whose roots this joins need no more comparison; all
    others are compared.
    """
    best = found.groupBy(F.least("ra", "rb").alias("_r"), F.greatest("ra", "rb").alias("_s")).agg(
        F.min(F.struct("differing", "a", "b")).alias("_best")).select("_best.a", "_best.b")
    links = cut_lineage(root_links(rooted, verified_links(texts, best)))
    joined = components(links).select(F.xxhash64("node").alias("_r"), F.xxhash64("root").alias("_to"))
    left = joined.select(F.col("_r").alias("ra"), F.col("_to").alias("_ta"))
    right = joined.select(F.col("_r").alias("rb"), F.col("_to").alias("_tb"))
    rest = found.join(left, "ra", "left").join(right, "rb", "left").where(
        F.coalesce("_ta", "ra") != F.coalesce("_tb", "rb")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = cut_lineage(root_links(rooted, verified_links(texts, rest)))
    return components(links.union(more))


def _node(k1: str, k2: str) -> Column:
    return F.concat(F.hex(k1), F.lit("-"), F.hex(k2))


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, no, class_id, stays: every line whose class has more than one line; the others are alone and stay."""
    lines = document_lines(docs)
    pairs = cut_lineage(candidate_pairs(signatures(lines)))
    texts = line_texts(lines, pairs)
    stars = cut_lineage(verified_links(texts, pairs))
    roots = components(stars)
    node = _node("k1", "k2").alias("node")
    rooted = cut_lineage(texts.select("k1", "k2", "line", node).join(roots, "node", "left").select(
        "k1", "k2", "line", "node", F.coalesce("root", "node").alias("root")))
    unsettled = cut_lineage(rooted.join(open_lines(pairs, rooted), "k1", "left_semi"))
    found = cut_lineage(prefix_pairs(unsettled))
    if not found.isEmpty():
        joined = cut_lineage(joined_roots(texts, rooted, found))
        nodes = roots.union(joined.select("node", F.col("node").alias("root"))).distinct()
        roots = nodes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select(
            "node", F.coalesce("_to", "root").alias("root"))
    occurrences = lines.select("doc_id", "no", _node("k1", "k2").alias("node"))
    repeated = occurrences.groupBy("node").agg(F.count("*").alias("_times")).where("_times > 1").select("node")
    classed = repeated.join(roots, "node", "full_outer").select("node", F.coalesce("root", "node").alias("class_id"))
    placed = cut_lineage(occurrences.join(classed, "node").select("doc_id", "no", "class_id"))
    first = placed.groupBy("class_id").agg(F.min(F.struct("doc_id", "no")).alias("_first"))
    return placed.join(first, "class_id").select(
        "doc_id", "no", "class_id", (F.struct("doc_id", "no") == F.col("_first")).alias("stays"))


def dropped_lines(classes: DataFrame) -> DataFrame:
    """_doc, dropped (line numbers), first_class: a row per document that loses lines."""
    return classes.where(~F.col("stays")).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list("no").alias("dropped"), F.min("class_id").alias("first_class"))


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns as they are, but ``text`` without the lines that do not stay.

    A document that loses no line keeps its text (and a null text stays null); one that loses all has an empty text.
    """
    dropped = dropped_lines(line_classes(docs)).select("_doc", F.col("dropped").alias("_dropped"))
    joined = docs.join(dropped, F.col("doc_id").cast("long") == F.col("_doc"), "left")
    split = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(F.col("_lines")) - 1)
    kept = F.transform(F.array_except(every, "_dropped"), lambda i: F.element_at(F.col("_lines"), i + 1))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("_lines", split).select(*(text.alias("text") if name == "text" else joined[name] for name in docs.columns))
