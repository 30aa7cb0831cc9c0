"""Best-fit packing of tokenised documents into sequences of fixed capacity.

How well documents pack depends on their lengths alone, and there are at most ``capacity`` of these. So the counts by
length (a table of at most ``capacity`` rows) are packed first, on the driver: lengths above a third of the capacity go
at most twice into a sequence, each with the longest partner that still fits (greedy matching); shorter ones then go to
the tightest gap that holds them. The plan says for each length which of its pieces, by rank, go where. Ranks are given
in parallel in hashed buckets, so that no length, however common, is numbered in one task.

Defined cases: null text is empty and still has its end token; repeated rows are packed each; an empty table packs into
nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annodelta.llm.bpe import read_ranks, text_groups
from annodelta.llm.text import whole_text
from annodelta.session import cut_lineage

END_ID = 2
BUCKET_ROWS = 20_000
ROWS_AT_ONCE = 256  # of texts taken out of a batch together


@cache
def _tokens(path: str) -> tiktoken.Encoding:
    """The merges of the tokenizer file, run by the rank library, which is several times faster (tests compare the two).
    The added tokens of the file are found inside texts too, as its own library does."""
    with open(path, encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file).get("added_tokens") or []}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens=added)


@cache
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids as the tokenizer file's own library gives them; the rank library cannot take very long runs of one class."""
    try:
        return _tokens(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pieces of ``capacity`` tokens; the first takes what is left over."""
    first = len(ids) % capacity
    edges = [0, *range(first or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
    return [ids[a:b] for a, b in zip(edges, edges[1:])]


def _cutting(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(begin, ROWS_AT_ONCE) for batch in batches for begin in range(0, batch.num_rows, ROWS_AT_ONCE))
        for rows_of in slices:
            keys, texts = rows_of.column(0).to_pylist(), rows_of.column(1).to_pylist()
            for part in text_groups(texts):
                rows = []
                for key, text in zip(keys[part], texts[part]):
                    start, ids = 0, token_ids(text, path)
                    for n, piece in enumerate(cut(np.append(ids, END_ID).astype("<u4"), capacity)):
                        rows.append((key, n, start, len(piece), zlib.crc32(piece.tobytes())))
                        start += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's tokens (with the end token) cut to the capacity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_cutting(path, capacity),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): ranks of a length in a row go to sequences in a row.

    Works on groups of sequences filled alike, so the work follows the number of different lengths, not of documents.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, count)
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + count, sequence, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    third = capacity / 3
    for length in sorted((n for n in left if n > third), reverse=True):
        while left[length]:
            partner = max((n for n in left if third < n <= capacity - length and left[n] > (n == length)), default=None)
            if partner is None:
                count = left[length]
            elif partner == length:
                count = left[length] // 2
            else:
                count = min(left[length], left[partner])
            place(length, count, sequences, 0)
            if partner is not None:
                place(partner, count, sequences, length)
            leave(capacity - length - (partner or 0), sequences, count)
            sequences += count
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                count = -(-left[length] // fit)
                leave(capacity, sequences, count)
                sequences += count
                continue
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            taken = min(count, left[length])
            place(length, taken, first, capacity - gap)
            leave(gap - length, first, taken)
            leave(gap, first + taken, count - taken)
    return rows


def pack(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset."""
    rows = cut_lineage(cut_pieces)
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counted = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    by_length = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "_bucket", F.coalesce(F.sum("_rows").over(by_length), F.lit(0).cast("long")).alias("_base"))
    counts = {r["length"]: r["_rows"] for r in counted.groupBy("length").agg(F.sum("_rows").alias("_rows")).collect()}
    planned = sorted(plan(counts, capacity))  # by length, then rank
    table = np.array(planned, dtype=np.int64).reshape(-1, 5)
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_rank"))
    return ranked.mapInArrow(_placing(table), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                              "sequence_id long, offset long")


def _placing(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``table``: the plan, whose size is bounded by the number of lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, lengths << 48 | ranks, side="right") - 1
            row = table[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + ranks - row[:, 1]), pa.array(row[:, 4])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run
