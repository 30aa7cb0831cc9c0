"""Ranked lexical search: exact inner products over sparse ball trees.

A document's score for an item is an inner product of integers: term weights of the item times term values of the
document. Only terms that some item holds matter, so documents shrink to those. They are dealt by their heaviest term (common
ones salted by their document frequency), so that a block of documents is alike, and each block becomes a ball tree: a node has
its centroid and, for each group of terms of like weight, the radius around it. Centroid product plus query norm times radius,
summed over the groups and rounded up, bounds the score of everything below a node. A task goes through its blocks with the best
documents found so far, takes nodes best first, and leaves a block when no bound reaches the last place; leaves
are scored in exact integers. The best of all tasks meet at the end.

The items are taken in groups whose terms stay below ``GROUP_BYTES``; each group passes over the documents once. So what
tasks and the driver hold of the items has a bound, however many there are.

Defined cases: null text has no terms; rows sharing an item_id are one item, rows sharing a doc_id are ranked each; a null
item_id is an item, a null doc_id ranks last among equal scores; items without terms and documents with score 0 give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annodelta.llm.text import lower_ascii, mark_words, whole_text
from annodelta.session import cut_lineage

#: Bytes of item terms (with 16 for each) that one pass over the documents looks for.
GROUP_BYTES = 8 << 20
#: Items whose weights stand side by side in a dense matrix.
BLOCK_ITEMS = 256
#: Documents of a tree, and of a leaf.
BLOCK_DOCS = 4096
LEAF_DOCS = 32
#: Entries (document, term) after which a tree is closed in any case.
BLOCK_ENTRIES = 2_000_000
#: Groups of terms with a radius each: the more, the closer the bounds.
GROUPS = 256
#: Rounding of sums in doubles stays far below these shares.
BOUND_SLACK, RADIUS_SLACK = 1e-9, 1e-10

#: Separators to blanks and A-Z to lower case; bytes beyond ASCII stay.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(mark_words(lower_ascii(whole_text()))).alias("term"))
    return words.distinct()


def _featuring(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.keys()
        for batch in batches:
            sizes, ids, counts = [], [], []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().translate(_TABLE).split()
                found = Counter(filter(wanted.__contains__, words))
                sizes.append(len(words))
                ids.append([vocabulary[word] for word in found])
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "ids", "counts"])

    return run


def features(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), ids and counts of the terms in ``vocabulary`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_featuring(vocabulary), "doc_id long, n long, ids array<int>, counts array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _placing(weights: np.ndarray, cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the heaviest term, the number of cells its documents are dealt to, and the term values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids, sizes = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)
            tf = batch.column("counts").flatten().to_numpy().astype(np.int64)
            m = np.repeat(batch.column("m").to_numpy(), sizes)
            values = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            lead = ids[np.lexsort((ids, -weights[ids], doc))][first]
            values = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lead, pa.int64()), pa.array(cells[lead], pa.int64()), lists, values],
                names=["doc_id", "lead", "cells", "ids", "values"])

    return run


class BallTree:
    """A tree over sparse documents given as rows of ``cols`` (positions in ``weights``) and integer ``values``."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, weights: np.ndarray, groups: np.ndarray, leaf: int) -> None:
        self.groups, self.n_groups = groups, int(groups.max(initial=-1)) + 1
        self.cols, self.starts = cols, np.concatenate([[0], np.cumsum(sizes)])
        self.scaled = np.sqrt(weights.astype(np.float64))[cols] * values
        self.width = len(weights)
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[np.ndarray] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[int] = []  # the left one's number, the right one follows; 0 for a leaf
        order = np.arange(len(sizes))
        waiting = [(0, 0, len(sizes))]
        self._room()
        while waiting:
            node, low, high = waiting.pop()
            own = order[low:high]
            ranking = self._measure(node, own, high - low > leaf)
            self.spans[node] = low, high
            if ranking is not None:
                order[low:high] = own[ranking]
                middle, left = (low + high) // 2, self._room()
                right = self._room()
                self.children[node] = left
                waiting += [(left, low, middle), (right, middle, high)]
        at, rows = self._entries(order)
        self.order, self.cols, self.values = order, cols[at], values[at]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(order)))])

    def _room(self) -> int:
        self.centroids.append((np.empty(0, np.int64), np.empty(0)))
        self.radii.append(np.empty(0))
        self.spans.append((0, 0))
        self.children.append(0)
        return len(self.children) - 1

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and which of ``docs`` each belongs to."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return at, np.repeat(np.arange(len(docs)), sizes)

    def _measure(self, node: int, docs: np.ndarray, split: bool) -> np.ndarray | None:
        """Centroid and radii of a node; how to sort its documents if it is split."""
        at, rows = self._entries(docs)
        cols, scaled = self.cols[at], self.scaled[at]
        centre = np.bincount(cols, scaled, self.width) / len(docs)
        cells, shape = rows * self.n_groups + self.groups[cols], (len(docs), self.n_groups)
        own = np.bincount(self.groups, centre * centre, self.n_groups)
        squares = np.bincount(cells, scaled * scaled, shape[0] * shape[1]).reshape(shape)
        apart = own + squares - 2 * np.bincount(cells, scaled * centre[cols], shape[0] * shape[1]).reshape(shape)
        slack = RADIUS_SLACK * (own + squares.max(axis=0))
        held = np.flatnonzero(centre)
        self.centroids[node] = held, centre[held]
        self.radii[node] = np.sqrt(np.maximum(apart.max(axis=0), 0) + slack)
        if not split:
            return None

        def along(vector: np.ndarray) -> np.ndarray:
            return np.bincount(rows, scaled * vector[cols], len(docs))

        def dense(doc: int) -> np.ndarray:
            return np.bincount(cols[rows == doc], scaled[rows == doc], self.width)

        a = dense(int(np.argmax(apart.sum(axis=1))))
        b = dense(int(np.argmax(squares.sum(axis=1) - 2 * along(a))))
        return np.argsort(along(b - a), kind="stable")

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No document below a node (rows) scores higher for a query (columns). ``queries``: roots of the weights, a row each;
        ``norms``: their lengths by group."""
        products = np.stack([queries[:, held] @ values for held, values in self.centroids])
        return (products + np.stack(self.radii) @ norms.T) * (1 + BOUND_SLACK) + 1

    def leaf_scores(self, node: int, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf, in their order; every document has an entry."""
        low, high = self.spans[node]
        a, b = self.starts[low], self.starts[high]
        return np.add.reduceat(weights[self.cols[a:b]] * self.values[a:b], self.starts[low:high] - a)


class Best:
    """The best documents of one item so far: (minus score, null last, doc_id)."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, []

    def least(self) -> int:
        """A document below this score has no place."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        found = np.flatnonzero(scores >= self.least())
        if len(found) > self.top:
            found = found[np.lexsort((ids[found], missing[found], -scores[found]))[:self.top]]
        if len(found):
            self.rows = sorted([*self.rows, *zip((-scores[found]).tolist(), missing[found].tolist(), ids[found].tolist())])[:self.top]


def search_tree(tree: BallTree, bounds: np.ndarray, weights: np.ndarray, ids: np.ndarray, missing: np.ndarray, best: Best) -> int:
    """Goes through the tree best first for one item (``bounds``: by node); returns the leaves scored."""
    heap, leaves = [(-bounds[0], 0)], 0
    while heap and -heap[0][0] >= best.least():
        node = heapq.heappop(heap)[1]
        left = tree.children[node]
        if left:
            for child in (left, left + 1):
                heapq.heappush(heap, (-bounds[child], child))
        else:
            leaves += 1
            docs = tree.order[slice(*tree.spans[node])]
            best.take(tree.leaf_scores(node, weights), ids[docs], missing[docs])
    return leaves


def group_norms(weights: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Lengths of the queries' roots of weights by group; no group is empty."""
    order = np.argsort(groups, kind="stable")
    return np.sqrt(np.add.reduceat(weights[:, order], np.searchsorted(groups[order], np.arange(groups.max() + 1)), axis=1))


class Items:
    """The items of a group: positions and weights of their terms."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray) -> None:
        self.weights = weights
        self.groups = np.empty(len(weights), dtype=np.int64)
        self.groups[np.lexsort((np.arange(len(weights)), weights))] = np.arange(len(weights)) * GROUPS // max(1, len(weights))
        self.terms = terms

    def search(self, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, keys: pa.Array, best: list[Best]) -> None:
        """Builds the tree of some documents (each with an entry) and improves ``best`` (by item)."""
        present, cols = np.unique(ids, return_inverse=True)
        groups = np.unique(self.groups[present], return_inverse=True)[1]
        tree = BallTree(sizes, cols, values, self.weights[present], groups, LEAF_DOCS)
        missing = keys.is_null().to_numpy(zero_copy_only=False)
        doc_ids = keys.fill_null(0).to_numpy()
        for first in range(0, len(self.terms), BLOCK_ITEMS):
            exact = np.zeros((len(self.terms[first:first + BLOCK_ITEMS]), len(present)), dtype=np.int64)
            for row, terms in zip(exact, self.terms[first:first + BLOCK_ITEMS]):
                place = np.searchsorted(present, terms)
                held = (place < len(present)) & (present[np.minimum(place, len(present) - 1)] == terms)
                row[place[held]] = self.weights[terms[held]]
            norms = group_norms(exact, groups)
            bounds = tree.bounds(np.sqrt(exact), norms)
            for k in range(len(exact)):
                search_tree(tree, bounds[:, k], exact[k], doc_ids, missing, best[first + k])


def _searching(items: Items, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items.terms]
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, values = (table.column(c).combine_chunks() for c in ("ids", "values"))
            items.search(ids.value_lengths().to_numpy().astype(np.int64), ids.flatten().to_numpy().astype(np.int64),
                         values.flatten().to_numpy(), table.column("doc_id").combine_chunks(), best)
            held.clear()

        docs = entries = 0
        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                stop = int(np.searchsorted(ends, before + BLOCK_ENTRIES - entries, side="right"))
                stop = min(max(stop, at + (not held)), at + BLOCK_DOCS - docs, batch.num_rows)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    docs, entries, at = docs + stop - at, entries + int(ends[stop - 1] - before), stop
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES or at < batch.num_rows:
                    finish()
                    docs = entries = 0
        if held:
            finish()
        rows = [(k, None if missing else key, -score) for k, own in enumerate(best) for score, missing, key in own.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc_id", "score"])

    return run


def _search_group(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """The best documents of the items in ``terms``, a table within the bound."""
    spark = docs.sparkSession
    held: dict[int | None, set[str]] = {}
    for row in terms.collect():
        held.setdefault(row["item_id"], set()).add(row["term"])
    names = sorted(held, key=lambda item: (item is None, item or 0))
    words = sorted(set().union(*held.values()))
    position = {word: k for k, word in enumerate(words)}
    found = cut_lineage(features(docs, {word.encode(): k for word, k in position.items()}).where("n > 0"))
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(words), dtype=np.int64)
    frequency = np.zeros(len(words), dtype=np.int64)
    for row in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row per word
        frequency[row["id"]] = row["count"]
        weights[row["id"]] = term_weight(n_docs, row["count"])
    items = Items([np.array(sorted(position[w] for w in held[name]), dtype=np.int64) for name in names], weights)
    norm = F.expr(f"10 + (cast(90 as decimal(38,0)) * n * {n_docs}) div {n_terms or 1}").cast("long")
    placed = found.where("size(ids) > 0").select("doc_id", norm.alias("m"), "ids", "counts").mapInArrow(
        _placing(weights, frequency // BLOCK_DOCS + 1), "doc_id long, lead long, cells long, ids array<int>, values array<long>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells"))).repartition(
        tasks, "lead", "cell").sortWithinPartitions("lead", "cell").select("doc_id", "ids", "values")
    results = dealt.mapInArrow(_searching(items, top), "item long, doc_id long, score long")
    by_item = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    return results.join(by_item, "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item by score, equal scores by ascending doc_id."""
    terms = cut_lineage(item_terms(items))
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    groups = -(-size // GROUP_BYTES) or 1
    own = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = [_search_group(docs, terms.where(own == k), top) for k in range(groups)]
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
