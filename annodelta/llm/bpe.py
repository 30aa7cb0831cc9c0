"""Byte-level BPE on whole texts: vectorised pre-tokenisation, cached pair merging, decoding with offsets.

Pre-tokenisation needs no regular expression. Every code point gets a class from a table, and a look at the next two
gives it a symbol. An automaton of eight states reads the symbols and tells at which of them a token starts. Reading one
symbol is a function from states to states, and such functions compose associatively: the text is cut into rows, the
functions of all rows are composed side by side, the row starts follow from a scan over the rows, and a second pass
marks the starts. The slices between starts go through a cache of merged pieces.

Workers read the vocabulary once from its path, which must be readable on every executor (part of the installed
package of public tokenizers by default).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.llm.text import whole_text

#: Code points handled at a time; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20
#: Pieces kept merged per worker and generation; those not met again while a generation fills are forgotten.
CACHE_PIECES = 250_000
#: Texts taken from a batch at a time.
BATCH_TEXTS = 256
WIDTH = 256
TAIL = 8

# Character classes.
LETTER, NUMBER, PUNCTUATION, BLANK, OTHER_SPACE, QUOTE = range(6)
# Symbols: the first three are classes; the rest depend on what follows.
SPACE_JOINS, SPACE_INNER, SPACE_ALONE, SHORT, LONG, STOP = 3, 4, 5, 6, 7, 8
# States: what the token read last can go on with.
S_NEW, S_LETTERS, S_NUMBERS, S_MARKS, S_PREFIX, S_SPACES, S_LAST, S_BOTH = range(8)


@cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 2, PUNCTUATION, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    # The code points with the Unicode property White_Space.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = OTHER_SPACE
    table[0x20] = BLANK
    table[0x27] = QUOTE
    return table


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]."""
    following = np.zeros((9, 8), dtype=np.uint8)
    starts = np.ones((9, 8), dtype=bool)
    for symbol, own in ((LETTER, S_LETTERS), (NUMBER, S_NUMBERS), (PUNCTUATION, S_MARKS)):
        following[symbol] = own
        starts[symbol, [own, S_PREFIX]] = False
    following[LETTER, [S_LAST, S_BOTH]] = [S_NEW, S_LAST]  # letters of a contraction
    starts[LETTER, [S_LAST, S_BOTH]] = False
    for symbol, own in ((SHORT, S_LAST), (LONG, S_BOTH)):
        following[symbol] = own
        following[symbol, [S_MARKS, S_PREFIX]] = S_MARKS  # inside a run of marks, or after its blank: no contraction
        starts[symbol, [S_MARKS, S_PREFIX]] = False
    following[SPACE_JOINS] = S_PREFIX
    following[SPACE_INNER] = S_SPACES
    starts[SPACE_INNER, S_SPACES] = False
    following[SPACE_ALONE] = S_NEW
    following[STOP] = S_NEW
    return following, starts


def _symbols(codes: np.ndarray, texts_end: np.ndarray) -> np.ndarray:
    """Symbols of texts laid end to end, each followed by one code of its own class (``texts_end``) that stops it."""
    kinds = _classes()[codes]
    kinds[texts_end] = 255
    after = np.append(kinds[1:], np.uint8(255))
    symbols = kinds.copy()
    is_space = (kinds == BLANK) | (kinds == OTHER_SPACE)
    space_next = (after == BLANK) | (after == OTHER_SPACE) | (after == 255)
    symbols[is_space] = SPACE_INNER
    symbols[(kinds == BLANK) & ~space_next] = SPACE_JOINS
    symbols[(kinds == OTHER_SPACE) & ~space_next] = SPACE_ALONE
    at = np.flatnonzero(kinds == QUOTE)
    symbols[at] = PUNCTUATION
    padded = np.append(codes, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    # The endings 's 't 'm 'd and 're 've 'll.
    symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = (one.astype(np.int64) << 21) | two
    symbols[at[np.isin(pairs, [(ord(a) << 21) | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    symbols[texts_end] = STOP
    return symbols


def _composed(columns: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The transition function of every row (its symbols are a column of ``columns`` per step) as its eight results."""
    states = np.tile(np.arange(8, dtype=np.uint8), (columns.shape[1], 1))
    for column in columns:
        states = flat[column[:, None].astype(np.intp) * 8 + states]
    return states


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a token starts at each symbol."""
    following, starts = _automaton()
    size = len(symbols)
    rows = -(-size // WIDTH)
    grid = np.full(rows * WIDTH, STOP, dtype=np.uint8)
    grid[:size] = symbols
    columns = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    flat = following.ravel()
    states = _composed(columns[-TAIL:], flat)
    # Mostly the last few symbols send every state to the same one; only other rows are composed from their beginning.
    open_rows = np.flatnonzero((states != states[:, :1]).any(axis=1))
    if len(open_rows):
        states[open_rows] = _composed(columns[:, open_rows], flat)
    entry = np.zeros(rows, dtype=np.uint8)
    state = S_NEW
    for row, step in enumerate(states.tolist()):
        entry[row] = state
        state = step[state]
    marks = np.empty((WIDTH, rows), dtype=bool)
    current, begun = entry.astype(np.intp), starts.ravel()
    for k, column in enumerate(columns):
        index = column.astype(np.intp) * 8 + current
        marks[k] = begun[index]
        current = flat[index]
    return marks.T.ravel()[:size]


def pieces(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text, which joined give the text."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begun = _scan(_symbols(codes, ends))
    cuts = np.flatnonzero(begun)  # the stops are starts as well
    edges = np.searchsorted(cuts, ends)
    places, result, first = cuts.tolist(), [], 0
    for last in edges.tolist():
        own = places[first:last + 1]
        result.append([joined[a:b] for a, b in zip(own, own[1:])])
        first = last + 1
    return result


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file or a tokenizer file of the same vocabulary; ids rise in the order of merges."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank (the leftmost of equals) merges until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    end = list(range(1, size + 1))  # of the part that starts here
    before = list(range(-1, size - 1))
    alive = [True] * size

    def pair(a: int) -> tuple[int, int, int] | None:
        b = end[a]
        rank = ranks.get(piece[a:end[b]]) if b < size else None
        return None if rank is None else (rank, a, end[b])

    queue = [p for p in map(pair, range(size - 1)) if p]
    heapq.heapify(queue)
    while queue:
        _, a, stop = heapq.heappop(queue)
        if not alive[a] or end[a] >= size or end[end[a]] != stop or end[a] == stop:
            continue
        b = end[a]
        if not alive[b]:
            continue
        alive[b] = False
        end[a] = stop
        if stop < size:
            before[stop] = a
        for start in (a, before[a]):
            if start >= 0 and (found := pair(start)):
                heapq.heappush(queue, found)
    parts, at = [], 0
    while at < size:
        parts.append(ranks[piece[at:end[at]]])
        at = end[at]
    return parts


class Encoder:
    """Encodes texts with a cache of merged pieces. ``merge_all`` maps pieces to ids; by default :func:`merge` does."""

    def __init__(self, path: str, merge_all: Callable[[list[str]], list[list[int]]] | None = None) -> None:
        if merge_all is None:
            ranks = read_ranks(path)
            merge_all = lambda new: [merge(piece.encode("utf-8", "replace"), ranks) for piece in new]
        self.merge_all = merge_all
        self.young: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = pieces(texts)
        self._learn(set().union(*split))
        cached = self.young
        return [np.frombuffer(b"".join([cached[p] for p in own]), dtype=np.int32) for own in split]

    def _learn(self, wanted: set[str]) -> None:
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        new = []
        for piece in wanted.difference(self.young):
            known = self.old.get(piece)
            if known is None:
                new.append(piece)
            else:
                self.young[piece] = known
        for piece, ids in zip(new, self.merge_all(new)):
            self.young[piece] = np.array(ids, dtype=np.int32).tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes laid end to end and where each id's begin (one more edge at the end)."""
    ranks = read_ranks(path)
    by_id = {i: token for token, i in ranks.items()}
    size = max(by_id) + 1
    lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], dtype=np.int64)
    flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def token_lengths(ids: np.ndarray, path: str) -> np.ndarray:
    edges = token_table(path)[1]
    return edges[ids + 1] - edges[ids]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, edges = token_table(path)
    starts, lengths = edges[ids], edges[ids + 1] - edges[ids]
    ends = np.cumsum(lengths)
    index = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return flat[index].tobytes()


def text_groups(texts: list[str], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of texts of about ``most`` characters together."""
    begun, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(begun, k)
            begun, size = k, 0
        size += len(text)
    if begun < len(texts):
        yield slice(begun, len(texts))


def _list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, type=kind))


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in text_groups(texts):
                ids = own.encode(texts[part])
                ends = [np.cumsum(token_lengths(i, path)) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [keys[part.start:part.stop], _list_array(ids, pa.int32()), _list_array(ends, pa.int64())],
                    names=["doc_id", "ids", "ends"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), ends (array<long>, the byte offset after each token) of every row.

    Null text is empty and has no ids; repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_encoding(path), "doc_id long, ids array<int>, ends array<long>")


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            decoded = []
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values
                decoded.append(b"" if ids is None else decode_ids(ids.to_numpy(zero_copy_only=False).astype(np.int64), path))
            yield from table.append_column("decoded", pa.array(decoded, pa.binary())).to_batches()

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary), the bytes of its ``ids``; null ids decode to nothing."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoding(path), f"{kinds}, decoded binary")


def _round_trip(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        shown = [str(i) for i in range(len(token_table(path)[1]) - 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                keys, texts = batch.column(0).slice(at, BATCH_TEXTS), batch.column(1).slice(at, BATCH_TEXTS).to_pylist()
                rows = []
                for part in text_groups(texts):
                    for ids in own.encode(texts[part]):
                        digest = hashlib.sha256(" ".join([shown[i] for i in ids.tolist()]).encode()).hexdigest()
                        rows.append((len(ids), digest, hashlib.sha256(decode_ids(ids, path)).hexdigest()))
                counts, *digests = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), *map(pa.array, digests)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids (decimal, joined by spaces) and of the decoded bytes of every row.

    Encodes and decodes in one pass, so that neither ids nor offsets leave the task; otherwise as :func:`encode`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
