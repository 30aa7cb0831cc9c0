"""Alignment of two tokenizers' tokens over the same texts, counted corpus-wide.

A text is tokenised whole by both. No token of either vocabulary crosses from a visible character to a blank, so of the
stretches between such places each is tokenised once in a chunk, many laid end to end at a time. Where a token of each ends
at the same byte and the next token of each begins with a space, the text is cut: such verified anchors leave windows of a few
token ids, and equal windows align equally, so a chunk aligns each window once, found by its id tuples.

Texts are taken in chunks of bounded size. A chunk becomes one row: its documents as runs of window numbers, its distinct
windows as runs of pair numbers, its distinct id pairs with their counts. Only the pairs are exploded, summed over all
chunks, and joined back to the chunks they came from; each chunk then weighs its own documents. Nothing grows with the
corpus in any task, and no table is broadcast: the memory of a task follows the chunk.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens (zeros,
empty digest); repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annodelta.llm.bpe import read_ranks, text_groups
from annodelta.llm.text import whole_text
from annodelta.session import cut_lineage

#: Code points of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 12 << 20
#: Code points tokenised at a time.
BATCH_CHARS = 1 << 16
#: Texts taken from a batch at a time.
BATCH_TEXTS = 64

Window = tuple[bytes, bytes]
#: From a visible character to a blank.
_BREAK = re.compile(r"(?<=\S)(?= )")


def _spread(edges: np.ndarray, values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The values of the given runs, one run after the other."""
    sizes = np.diff(edges)[runs]
    ends = np.cumsum(sizes)
    return values[np.repeat(edges[runs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Side:
    """The bytes of a vocabulary's tokens."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens) + 1
        own = [tokens.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(t) for t in own], dtype=np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in own])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(own), dtype=np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        index = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[index].tobytes()


def _piece_bytes(tool: sentencepiece.SentencePieceProcessor) -> dict[int, bytes]:
    return {i: bytes([int(tool.id_to_piece(i)[3:-1], 16)]) if tool.is_byte(i) else
            tool.id_to_piece(i).replace("▁", " ").encode() for i in range(tool.get_piece_size())}


class Aligner:
    """Both tokenizers, and the windows met so far."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        ranks = read_ranks(byte_path)
        self.fast = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(byte_path)
        self.whole.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a = Side({i: token for token, i in ranks.items()})
        self.b = Side(_piece_bytes(self.pieces))
        inner = re.compile("[^▁]▁")
        if any(inner.search(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())):
            raise ValueError(f"{piece_path}: pieces cross blanks")
        size = max(len(self.a.lengths), len(self.b.lengths))
        self.spelled = [f"{i}{mark}" for mark in ",|;" for i in range(size)]
        self.spelled_size = np.array([len(text) for text in self.spelled], dtype=np.int64)

    def byte_ids(self, text: str) -> np.ndarray:
        """Ids of the byte-level tokenizer; the rank library gives the same ones faster but not on very long runs."""
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except ValueError:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def piece_ids(self, text: str) -> np.ndarray:
        """Ids of the piece tokenizer, which puts a space before its text; a blank alone it would drop."""
        return np.array(self.pieces.encode(text[1:]) if text != " " else [self.pieces.piece_to_id("▁")], dtype=np.uint32)

    def tokenise(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for stretches (each begins with a space) and, by stretch, how many; none where the bytes
        of the tokens are not those of the stretch."""
        counts = np.zeros((2, len(stretches)), dtype=np.int64)
        found: tuple[list, list] = ([np.empty(0, np.uint32)], [np.empty(0, np.uint32)])
        taken: list[int] = []
        possible = [k for k, stretch in enumerate(stretches) if "▁" not in stretch]  # its piece would be a space
        # One that ends with white space (at the end of a text) would run into the next one.
        plain = [k for k in possible if not stretches[k][-1].isspace()]
        waiting = [plain[part] for part in text_groups([stretches[k] for k in plain], BATCH_CHARS)]
        waiting += [[k] for k in possible if stretches[k][-1].isspace()]
        while waiting:
            own = waiting.pop()
            joined = "".join([stretches[k] for k in own])
            raw, bounds = joined.encode(), np.cumsum([len(stretches[k].encode()) for k in own])
            sides = [(side, ids, side.ends(ids)) for side, ids in ((self.a, self.byte_ids(joined)), (self.b, self.piece_ids(joined)))]
            if all(len(ids) and ends[-1] == len(raw) and side.joined(ids, ends) == raw for side, ids, ends in sides):
                for k, (_, ids, ends) in enumerate(sides):
                    counts[k, own] = np.diff(np.searchsorted(ends, bounds) + 1, prepend=0)
                    found[k].append(ids)
                taken += own
            elif len(own) > 1:
                waiting += [[k] for k in own]
        order = np.argsort(np.array(taken, dtype=np.int64))
        edges = [np.concatenate([[0], np.cumsum(own[np.array(taken, dtype=np.int64)], dtype=np.int64)]) for own in counts]
        a, b = (_spread(own, np.concatenate(ids), order) for own, ids in zip(edges, found))
        return a, counts[0], b, counts[1]

    def cut(self, a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> tuple[list[Window], np.ndarray, np.ndarray]:
        """The distinct windows of tokenised stretches; the windows of each stretch by number, and their edges."""
        a_ends, b_ends = self.a.ends(a), self.b.ends(b)
        shared, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        anchored = np.ones(len(shared), dtype=bool)  # the end of all is one
        anchored[:-1] = self.a.spaced[a[a_last[:-1] + 1]] & self.b.spaced[b[b_last[:-1] + 1]]
        a_cuts, b_cuts = ((4 * (last[anchored] + 1)).tolist() for last in (a_last, b_last))
        a_raw, b_raw = a.tobytes(), b.tobytes()
        numbers: dict[Window, int] = {}
        windows = np.array([numbers.setdefault((a_raw[p:q], b_raw[r:s]), len(numbers))
                            for p, q, r, s in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts)], dtype=np.int64)
        # A stretch begins with a space, so windows end with it.
        edges = np.searchsorted(a_cuts, 4 * np.cumsum(a_counts), side="right")
        return list(numbers), windows, np.concatenate([[0], edges])

    def align(self, windows: list[Window]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its groups as text and their number; the links (id of a << 32 | id of b) and their edges by window.

        The bytes of a window are the same on both sides, so windows laid end to end are aligned on one axis.
        """
        a, b = (np.frombuffer(b"".join([w[side] for w in windows]), dtype=np.uint32).astype(np.int64) for side in (0, 1))
        a_ends, b_ends = self.a.ends(a), self.b.ends(b)
        window_ends = a_ends[np.cumsum([len(w[0]) // 4 for w in windows], dtype=np.int64) - 1] if windows else a_ends
        ends = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # Tokens in the order of their groups, those of a first; each with the mark that follows it.
        group = np.concatenate([np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)])
        closes = np.concatenate([np.isin(a_ends, shared, assume_unique=True), np.isin(b_ends, shared, assume_unique=True)])
        marks = np.where(closes, np.repeat([1, 2], [len(a), len(b)]), 0)
        order = np.argsort(group, kind="stable")
        codes = (marks * (len(self.spelled) // 3) + np.concatenate([a, b]))[order]
        spelled = "".join([self.spelled[code] for code in codes.tolist()])
        by_group = np.concatenate([[0], np.searchsorted(group[order], np.arange(len(shared)), side="right")])
        places = np.concatenate([[0], np.cumsum(self.spelled_size[codes])])[by_group]
        group_edges = np.concatenate([[0], np.searchsorted(shared, window_ends) + 1]) if windows else np.zeros(1, np.int64)
        cuts = places[group_edges].tolist()
        texts = [spelled[p:q - 1] for p, q in zip(cuts, cuts[1:])]
        link_edges = np.concatenate([[0], np.searchsorted(ends, window_ends) + 1]) if windows else np.zeros(1, np.int64)
        return texts, np.diff(group_edges), links, link_edges


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    *[(name, pa.list_(pa.int64())) for name in ("n_a", "n_b", "n_groups", "n_links")],
    ("digests", pa.list_(pa.string())), *[(name, pa.binary()) for name in ("doc_windows", "window_pairs")],
    ("pair_keys", pa.list_(pa.int64())), ("pair_counts", pa.list_(pa.int64())),
])
CHUNK_COLUMNS = ("chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
                 "digests array<string>, doc_windows binary, window_pairs binary, pair_keys array<long>, pair_counts array<long>")


def _packed(sizes: np.ndarray, values: np.ndarray) -> bytes:
    """Runs of small numbers as one compressed block: how many runs, their lengths, their numbers."""
    raw = np.concatenate([[len(sizes)], sizes, values]).astype(np.uint32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the runs (one more than runs) and their numbers."""
    raw = np.frombuffer(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True), np.uint32)
    sizes = raw[1:1 + raw[0]]
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), raw[1 + raw[0]:]


class Chunk:
    """Documents gathered until their texts reach the bound."""

    def __init__(self, own: Aligner) -> None:
        self.own = own
        self.numbers: dict[str, int] = {}
        self.keys: list[int | None] = []
        self.runs: list[np.ndarray] = []
        self.chars = 0

    def add(self, keys: list, texts: list[str]) -> None:
        numbers = self.numbers
        for key, text in zip(keys, texts):
            stretches = _BREAK.split(" " + text) if text else []
            self.keys.append(key)
            self.runs.append(np.array([numbers.setdefault(s, len(numbers)) for s in stretches], dtype=np.int64))
            self.chars += len(text)

    def row(self, name: int) -> pa.RecordBatch:
        a, a_counts, b, b_counts = self.own.tokenise(list(self.numbers))
        self.runs = [run if (a_counts[run] > 0).all() else run[:0] for run in self.runs]
        windows, stretch_windows, stretch_edges = self.own.cut(a, a_counts, b, b_counts)
        texts, groups, flat, edges = self.own.align(windows)
        stretches = np.concatenate(self.runs)
        numbers = _spread(stretch_edges, stretch_windows, stretches)
        stretch_doc = np.repeat(np.arange(len(self.runs)), [len(run) for run in self.runs])
        n_a, n_b, sizes = (np.bincount(stretch_doc, counts[stretches], len(self.runs)).astype(np.int64)
                           for counts in (a_counts, b_counts, np.diff(stretch_edges)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        links = np.diff(edges)
        n_groups, n_links = (np.bincount(doc, counts[numbers], len(sizes)).astype(np.int64) for counts in (groups, links))
        pairs, pair_numbers = np.unique(flat, return_inverse=True)
        met = np.bincount(numbers, minlength=len(texts))
        counts = np.bincount(pair_numbers, np.repeat(met, links), len(pairs)).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        spelled = [texts[w] for w in numbers.tolist()]
        digests = [hashlib.sha256(";".join(spelled[p:q]).encode()).hexdigest() if p < q else "" for p, q in zip([0, *ends], ends)]
        column = lambda values: pa.array([values], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), *map(column, (self.keys, n_a, n_b, n_groups, n_links)),
            pa.array([digests], pa.list_(pa.string())), pa.array([_packed(sizes, numbers)], pa.binary()),
            pa.array([_packed(links, pair_numbers)], pa.binary()),
            column(pairs), column(counts)], schema=CHUNK_SCHEMA)


def _chunking(byte_path: str, piece_path: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        held = Chunk(own)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                held.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if held.chars >= most:
                    yield held.row(name)
                    held, name = Chunk(own), name + 1
        if held.keys:
            yield held.row(name)

    return run


def chunks(docs: DataFrame, byte_path: str, piece_path: str, most: int = CHUNK_CHARS) -> DataFrame:
    """The aligned documents, one row per chunk of about ``most`` code points."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_chunking(byte_path, piece_path, most), CHUNK_COLUMNS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (id of a << 32 | id of b), total, is_best (the highest total of its b id) over all chunks."""
    each = aligned.select(F.explode(F.arrays_zip("pair_keys", "pair_counts")).alias("p"))
    totals = each.groupBy(F.col("p.pair_keys").alias("pair")).agg(F.sum("p.pair_counts").alias("total"))
    by_b = F.expr("pair & 4294967295")
    highest = totals.groupBy(by_b.alias("b")).agg(F.max("total").alias("highest"))
    return totals.withColumn("b", by_b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("is_best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weigh(held: pa.Table, values: pa.Table) -> pa.Table:
    """Documents of one chunk with the sums over their links; ``values``: its pairs with their corpus-wide counts."""
    row = {name: held.column(name)[0] for name in held.column_names}
    order = np.argsort(values.column("pair").to_numpy())  # the numbers of pairs follow their order
    weights = [values.column("total").to_numpy()[order], values.column("is_best").to_numpy(zero_copy_only=False)[order].astype(np.int64)]
    pair_edges, pairs = _unpacked(row["window_pairs"].as_py())
    doc_edges, windows = _unpacked(row["doc_windows"].as_py())
    sums = []
    for weight in weights:
        by_window = np.diff(np.concatenate([[0], np.cumsum(weight[pairs])])[pair_edges])
        sums.append(np.diff(np.concatenate([[0], np.cumsum(by_window[windows])])[doc_edges]))
    plain = [row[name].values for name in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*plain, pa.array(sums[1], pa.int64()), pa.array(sums[0], pa.int64()), row["digests"].values],
                    names=[part.split()[0] for part in RESULT.split(", ")])


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, most: int = CHUNK_CHARS) -> DataFrame:
    """Per row: token and group counts, links, links that are their b id's most frequent, the sum of the links' counts
    over the corpus, and the digest of the groups."""
    aligned = cut_lineage(chunks(docs, byte_path, piece_path, most))
    own = aligned.select(F.col("chunk").alias("of_chunk"), F.explode("pair_keys").alias("pair"))
    values = own.join(pair_counts(aligned), "pair").select("of_chunk", "pair", "total", "is_best")
    weighed = aligned.drop("pair_keys", "pair_counts").groupBy("chunk").cogroup(values.groupBy("of_chunk"))
    return weighed.applyInArrow(_weigh, RESULT)
