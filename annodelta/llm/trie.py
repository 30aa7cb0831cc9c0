"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within ``radius`` bits agree on one of radius + 1 blocks of bits. For each block the fingerprints are rotated
so that the block comes first; those with the same block are one subtree, the unit of distribution. A subtree is joined
with itself: node pairs go down together bit by bit, each pair carries the differing bits it may still spend, and a pair
that spends too many is dropped. A sorted array of fingerprints is the trie: a node is a range of it, and all pairs of
one level are moved in array operations. Pairs of small nodes are compared directly. Node pairs whose fingerprints are
already known to be connected are not followed.

Units of more than ``unit_rows`` fingerprints (a common block) are split before by the next eight bits into pairs of
child nodes, again within the budget, until they are small enough; this repeats down to single fingerprints and loses no
pair. Equal fingerprints are one; a unit reports a star per connected group, not its pairs.

Defined cases: null or empty text has fingerprint zero and is linked like any other; repeated rows appear each; a null
doc_id is never a class name unless nothing else is in the class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.components import components
from annodelta.llm.text import lower_ascii, neighbours, space_words, whole_text
from annodelta.llm.votes import sign_bits
from annodelta.session import cut_lineage

SHINGLE_WORDS = 4
LEAF_PAIRS = 32
FRONTIER = 1 << 18
STEP_BITS = 8


def document_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) of every row: majority bits of the hashes of its word shingles, repeats included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                       space_words(lower_ascii(whole_text())).alias("_words"))
    many = F.size("_words") >= SHINGLE_WORDS
    whole = F.struct(F.array_join("_words", " ").alias("w0"),
                     *(F.lit(None).cast("string").alias(f"w{k}") for k in range(1, SHINGLE_WORDS)))
    shingles = F.when(many, F.slice(neighbours(F.col("_words"), SHINGLE_WORDS), 1, F.size("_words") - (SHINGLE_WORDS - 1))
                      ).when(F.size("_words") > 0, F.array(whole))
    exploded = rows.select("doc_id", "_row", F.posexplode_outer(shingles).alias("_at", "_s"))
    text = F.concat_ws(" ", *(F.col(f"_s.w{k}") for k in range(SHINGLE_WORDS)))
    hashed = exploded.select("doc_id", "_row", F.coalesce("_at", F.lit(0)).alias("_at"),
                             F.when(F.col("_s").isNotNull(), F.xxhash64(text)).alias("_hash"))
    return sign_bits(hashed, ["doc_id", "_row"], "_at", "_hash").drop("_row")


def near_classes(prints: DataFrame, radius: int = 4, unit_rows: int = 20_000) -> DataFrame:
    """``prints`` (doc_id, fingerprint) with component_id: the smallest doc_id reachable over links of ``radius`` bits."""
    prints = cut_lineage(prints)
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    links = trie_links(distinct.where(F.col("node").isNotNull()), radius, unit_rows)
    roots = components(links).select("node", "root")
    classes = distinct.join(roots, "node", "left").select(
        F.col("fingerprint").alias("_print"), F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, prints["fingerprint"] == classes["_print"]).select("doc_id", "fingerprint", "component_id")


def trie_links(distinct: DataFrame, radius: int, unit_rows: int) -> DataFrame:
    """(a, b): links between nodes that connect all within ``radius`` bits; ``distinct``: fingerprint, node, no repeats."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    turned = [F.struct(F.lit(r).alias("turn"), F.lit(b - a).alias("width"), _rotated(a).alias("bits"))
              for r, (a, b) in enumerate(zip(edges, edges[1:]))]
    rows = distinct.select("node", F.explode(F.array(*turned)).alias("t")).select(
        F.concat_ws(":", F.col("t.turn"), F.expr("shiftrightunsigned(t.bits, 64 - t.width)")).alias("unit"),
        F.lit(0).alias("side"), "node", F.col("t.bits").alias("bits"), F.col("t.width").alias("depth"),
        F.lit(radius).alias("budget"))
    ready = []
    while True:
        sizes = rows.groupBy("unit").agg(F.count("*").alias("_rows"), F.max("depth").alias("_depth"))
        large = cut_lineage(sizes.where((F.col("_rows") > unit_rows) & (F.col("_depth") <= 64 - STEP_BITS)).select("unit"))
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "unit", "left_anti"))
        rows = cut_lineage(_split(rows.join(large, "unit")))
    units = ready[0]
    for more in ready[1:]:
        units = units.unionByName(more)
    dealt = units.repartition("unit").sortWithinPartitions("unit", "side", "bits")
    return dealt.mapInArrow(_joining, "a long, b long")


def _rotated(left: int) -> Column:
    bits = F.col("fingerprint")
    return bits if not left else F.shiftleft(bits, left).bitwiseOR(F.shiftrightunsigned(bits, 64 - left))


def _split(rows: DataFrame) -> DataFrame:
    """The rows of large units as rows of pairs of their child nodes, eight bits further down."""
    child = F.expr(f"cast(shiftrightunsigned(bits, 64 - {STEP_BITS} - depth) & {(1 << STEP_BITS) - 1} as int)")
    own = cut_lineage(rows.withColumn("child", child))
    # A unit of one node joins with itself; one of two nodes joins side 0 with side 1.
    twofold = own.groupBy("unit").agg(F.max("side").alias("two"))
    there = own.groupBy("unit", "side", "child").agg(F.lit(1).alias("_one")).select(
        F.col("unit").alias("_unit"), F.col("side").alias("_side"), F.col("child").alias("_other"))
    joined = own.join(twofold, "unit").join(
        there, (F.col("unit") == F.col("_unit")) & (F.col("_side") == F.when(F.col("two") == 1, 1 - F.col("side")).otherwise(0))
        & (F.bit_count(F.col("child").bitwiseXOR(F.col("_other"))) <= F.col("budget")))
    alone = F.col("two") == 0
    first = F.when(alone, F.least("child", "_other")).when(F.col("side") == 0, F.col("child")).otherwise(F.col("_other"))
    second = F.when(alone, F.greatest("child", "_other")).when(F.col("side") == 0, F.col("_other")).otherwise(F.col("child"))
    side = F.when(alone, (F.col("child") > F.col("_other")).cast("int")).otherwise(F.col("side"))
    return joined.select(
        F.concat_ws("/", "unit", first, second).alias("unit"), side.alias("side"), "node", "bits",
        (F.col("depth") + STEP_BITS).alias("depth"),
        (F.col("budget") - F.bit_count(F.col("child").bitwiseXOR(F.col("_other")))).alias("budget"))


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole units in, links out; a unit is kept until its last row has come."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        names = table["unit"].combine_chunks()
        last = names[-1].as_py()
        whole = int(pc.index(names, last).as_py())
        if whole:
            yield from _unit_links(table.slice(0, whole))
        kept = table.slice(whole)
    if kept is not None:
        yield from _unit_links(kept)


def _unit_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    codes = table["unit"].combine_chunks().dictionary_encode().indices.to_numpy()
    side, bits = table["side"].to_numpy(), table["bits"].to_numpy().view(np.uint64)
    node, budget, depth = table["node"].to_numpy(), table["budget"].to_numpy(), table["depth"].to_numpy()
    # Spark sorts signed longs: sort anew as unsigned.
    order = np.lexsort([bits, side, codes])
    codes, side, bits, node, budget, depth = (x[order] for x in (codes, side, bits, node, budget, depth))
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    ends = np.append(starts[1:], len(codes))
    ones = np.concatenate([[0], np.cumsum(side)])
    middle = ends - (ones[ends] - ones[starts])  # side 0 comes first
    two = middle < ends
    pairs = np.stack([starts, middle, np.where(two, middle, starts), ends, budget[starts]])
    join = TrieJoin(bits)
    for level in np.unique(depth[starts]):
        join.descend(pairs[:, depth[starts] == level], 63 - int(level))
    root = join.labels
    order = np.lexsort([node, root])  # name each group by its smallest node
    heads = np.append(True, root[order][1:] != root[order][:-1])
    smallest = node[order][heads][np.cumsum(heads) - 1]
    own = node[order]
    linked = smallest != own
    yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(smallest[linked])], names=["a", "b"])


class TrieJoin:
    """Self-join of a sorted array of fingerprints; ``labels`` names the connected group of each place."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.labels = np.arange(len(bits))
        self.ones: dict[int, np.ndarray] = {}

    def descend(self, pairs: np.ndarray, bit: int) -> None:
        """``pairs``: columns (a begin, a end, b begin, b end, budget), all at nodes that split at ``bit``."""
        stack = [(pairs, bit)]
        while stack:
            pairs, bit = stack.pop()
            pairs = self._open(pairs)
            sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
            leaf = (sizes <= LEAF_PAIRS) | (bit < 0)
            self._compare(pairs[:, leaf], bit)
            pairs = pairs[:, ~leaf]
            if not pairs.shape[1]:
                continue
            halves = np.array_split(self._children(pairs, bit), -(-4 * pairs.shape[1] // FRONTIER), axis=1)
            stack += [(half, bit - 1) for half in halves if half.shape[1]]

    def _open(self, pairs: np.ndarray) -> np.ndarray:
        """Without the pairs whose fingerprints are all in one group, and nodes of one fingerprint with themselves."""
        changes = np.concatenate([[0], np.cumsum(self.labels[1:] != self.labels[:-1])]) if len(self.labels) else self.labels
        same = ((changes[pairs[1] - 1] == changes[pairs[0]]) & (changes[pairs[3] - 1] == changes[pairs[2]])
                & (self.labels[pairs[0]] == self.labels[pairs[2]]))
        return pairs[:, ~same]

    def _children(self, pairs: np.ndarray, bit: int) -> np.ndarray:
        if bit not in self.ones:
            set_bits = (self.bits >> np.uint64(bit)) & np.uint64(1)
            self.ones[bit] = np.concatenate([[0], np.cumsum(set_bits.astype(np.int64))])
        ones = self.ones[bit]
        a0, a1, b0, b1, left = pairs
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        apart = a0 != b0  # a node with itself has its cross pair once
        children = [np.stack([a0, am, b0, bm, left]), np.stack([am, a1, bm, b1, left]),
                    np.stack([a0, am, bm, b1, left - 1]), np.stack([am, a1, b0, bm, left - 1])[:, apart]]
        joined = np.concatenate(children, axis=1)
        return joined[:, (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] >= 0)]

    def _compare(self, pairs: np.ndarray, bit: int) -> None:
        """Link what differs in no more bits than the budget from ``bit`` down (above, the budget is paid already)."""
        below = np.uint64((1 << (bit + 1)) - 1) if bit >= 0 else np.uint64(0)
        for part in np.array_split(pairs, max(1, -(-pairs.shape[1] // FRONTIER)), axis=1):
            na, nb = part[1] - part[0], part[3] - part[2]
            count = na * nb
            total = int(count.sum())
            if not total:
                continue
            within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(nb, count)
            a = np.repeat(part[0], count) + within // width
            b = np.repeat(part[2], count) + within % width
            near = np.bitwise_count((self.bits[a] ^ self.bits[b]) & below) <= np.repeat(part[4], count)
            self._link(a[near], b[near])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            la, lb = labels[a], labels[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
            while True:  # every label a root
                jumped = labels[labels]
                if (jumped == labels).all():
                    break
                labels[:] = jumped
