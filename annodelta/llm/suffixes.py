"""Suffix-array dedup of byte strings that repeat across documents.

A string of ``LENGTH`` bytes is removed from a document if it also starts in a document with a smaller id.

1. Anchors. In every window of ``LENGTH`` bytes the 24-byte gram of the least hash is its anchor, so equal windows have
   equal anchors at equal places. Anchors meet by hash; windows whose anchor is in one document only cannot repeat.
   This leaves the few parts of the texts that may.
2. Contexts. The windows of one anchor in a row are one context. Contexts meet by the hash of their anchor, equal ones as
   one with the smallest id.
3. Suffix array. Where an anchor has different contexts, these are laid end to end and their suffixes are sorted by the
   difference-cover algorithm: the triples at two of three places are sorted and named, the string of names is sorted
   recursively until names differ, the other suffixes are sorted by their first byte and the name behind, and both lists
   are merged. Adjacent suffixes are compared over their first ``LENGTH`` bytes; each run of equal ones has its smallest id.
4. The windows of larger ids are marked in their documents and the bytes they cover go.

Rows travel as compressed blobs per bucket or block, so the work per row is array work. What is already decided where it
is read (an anchor of several documents of one batch, a context that repeats in one block) is reported from there and
only one copy travels on: a string that very many documents share stays small where it meets.

Defined cases: null text is empty; a text shorter than a window loses nothing; a null doc_id counts as the largest;
rows with equal doc_id never remove from each other; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.llm.text import whole_text

LENGTH = 50
GRAM = 24
CHUNK = 1 << 20
BUCKET_BYTES = 12 << 20
NULL_ID = (1 << 63) - 1
BLOB = "target int, data binary"
WORD = 1 << 63
ROWS_AT_ONCE = 256  # of texts taken out of a batch together
ANCHORS_AT_ONCE = 1 << 20  # sent together: the more buckets, the more of them are needed for blobs of some size
CONTEXT_BYTES_AT_ONCE = 16 << 20
HEAD = struct.Struct("<3sq")  # type and length of a packed array


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of equal weight stand together, which suits sorted and small numbers.

    Each array, which may be empty, follows its type and length, so that many small blobs cost little.
    """
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        out += [HEAD.pack(a.dtype.str.encode(), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    arrays, at = [], 0
    while at < len(raw):
        kind, size = HEAD.unpack_from(raw, at)
        kind, at = np.dtype(kind.decode()), at + HEAD.size
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return arrays


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at every place."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    n = len(data) - GRAM + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(29)
        h += eight[k:k + n]
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place of every window, hash of the gram at every place); the leftmost of equals."""
    hashes = _gram_hashes(data)
    # The leading 40 bits decide, then the place: one running minimum gives both.
    least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64), hashes


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in chunks: (bytes, row of every byte, place in its text); long texts overlap by a window."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p for _, _, p in parts), dtype=np.uint8)
        lengths = [len(p) for _, _, p in parts]
        rows = np.repeat([r for r, _, _ in parts], lengths)
        places = np.arange(len(data)) + np.repeat(
            [b for _, b, _ in parts] - (np.cumsum(lengths) - lengths), lengths)
        return data, rows, places

    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for begun in range(0, len(text) - length + 1, CHUNK):
            part = text[begun:begun + CHUNK + length - 1]
            parts.append((row, begun, part))
            size += len(part)
            if size >= CHUNK:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


def _windows(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For every chunk: bytes, and of each window of one text its start, row, place in the text, anchor and anchor hash."""
    for data, rows, places in _segments(texts, length):
        anchors, hashes = window_anchors(data, length)
        starts = np.flatnonzero((rows[:len(anchors)] == rows[length - 1:])
                                & (places[length - 1:] - places[:len(anchors)] == length - 1))
        anchor = anchors[starts]
        yield data, starts, rows[starts], places[starts], anchor, hashes[anchor]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_target(target: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if len(target) and target.max() < 65_536:
        target = target.astype(np.uint16)  # sorted by counting
    order = np.argsort(target, kind="stable")
    target = target[order]
    cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(target))):
        yield int(target[a]), [c[order[a:b]] for c in columns]


def _blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["target", "data"])


def _first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    size = len(sorted_columns[0])
    new = np.zeros(size, dtype=bool)
    if size:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _send_anchors(buckets: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors by bucket of their hash: (hash, uid, block, place, state). State 0: to be decided; 1: shared, to be passed
    on; 2: a mark that the hash is shared."""
    def packed(h: np.ndarray, row: np.ndarray, uid: np.ndarray, block: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")  # rows and places ascend already
        h, row, uid, block, at = (c[order] for c in (h, row, uid, block, at))
        once = _first_of_runs(h, row, at)
        h, row, uid, block, at = (c[once] for c in (h, row, uid, block, at))
        run_of = np.cumsum(_first_of_runs(h)) - 1
        shared = (np.bincount(run_of, _first_of_runs(h, row)) > 1)[run_of]
        target = _bucket(h, buckets)
        mark = np.flatnonzero(shared & _first_of_runs(h))
        # What is decided goes to a bucket by its text, a mark for it to the bucket of its hash.
        target[shared] = (uid[shared].astype(np.uint64) >> np.uint64(17)) % np.uint64(buckets)
        take = np.concatenate([np.arange(len(h)), mark])
        state = np.concatenate([shared.astype(np.uint8), np.full(len(mark), 2, np.uint8)])
        target = np.concatenate([target, _bucket(h[mark], buckets)])
        rows = []
        for t, (own_h, own_uid, own_block, *rest) in _by_target(target, h[take], uid[take], block[take], at[take], state):
            # 48 bits of the hash tell anchors apart well enough here, and each text is named once.
            known, first, number = np.unique(own_uid, return_index=True, return_inverse=True)
            rows.append((t, pack_arrays(own_h >> np.uint64(16), number.astype(np.uint16 if len(known) < 65_536 else np.uint32),
                                        *rest, known, own_block[first])))
        return _blob_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows_before = size = 0
        for batch in batches:
            uid, block = batch.column("_uid").to_numpy(), batch.column("_block").to_numpy().astype(np.int32)
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for data, starts, row, place, anchor, hashed in _windows(texts, length):
                first = _first_of_runs(anchor)
                r = row[first]
                held.append((hashed[first], r + rows_before, uid[r], block[r], (place + anchor - starts)[first].astype(np.int32)))
                size += len(r)
                if size >= ANCHORS_AT_ONCE:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
            rows_before += batch.num_rows
        if size:
            yield packed(*map(np.concatenate, zip(*held)))

    return run


def _gathered(table: pa.Table) -> list[np.ndarray]:
    parts = [unpack_arrays(d) for d in table["data"].to_pylist()]
    return [np.concatenate(c) for c in zip(*parts)]


def _shared_anchors(table: pa.Table) -> pa.Table:
    """The places of anchors that more than one text has, by block: (uid, place)."""
    parts = [(h, uids[n], blocks[n], at, state)
             for h, n, at, state, uids, blocks in map(unpack_arrays, table["data"].to_pylist())]
    h, uid, block, at, state = (np.concatenate(c) for c in zip(*parts))
    passed = state == 1
    order = np.lexsort([uid, h])
    order = order[state[order] != 1]
    hs, us, st = h[order], uid[order], state[order]
    heads = _first_of_runs(hs)
    run_of = np.cumsum(heads) - 1
    several = np.bincount(run_of, _first_of_runs(hs, us)) > 1 if len(hs) else np.empty(0, bool)
    marked = np.bincount(run_of, st == 2) > 0 if len(hs) else np.empty(0, bool)
    decided = order[(several | marked)[run_of] & (st == 0)] if len(hs) else order
    chosen = np.concatenate([np.flatnonzero(passed), decided])
    rows = [(t, pack_arrays(*c)) for t, c in _by_target(block[chosen], uid[chosen], at[chosen])]
    return pa.Table.from_batches([_blob_batch(rows)])


def _block_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """uid, id and text of the different rows of a block."""
    uid = table["_uid"].to_numpy()
    _, first = np.unique(uid, return_index=True)
    taken = table.take(first)
    unpack = zstandard.ZstdDecompressor()
    return uid[first], taken["_id"].to_numpy(), [unpack.decompress(t) for t in taken["_packed"].to_pylist()]


def _send_contexts(buckets: int, length: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Contexts of shared anchors by bucket of the hash: (hash, uid, id, block, start, size, state) and their bytes.
    State 1: windows known to repeat, to be passed on."""
    def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        if not docs.num_rows or not blobs.num_rows:
            return pa.Table.from_batches([_blob_batch([])])
        block = docs["_block"][0].as_py()
        uid, ids, texts = _block_texts(docs)
        shared_uid, shared_at = _gathered(blobs)
        position = np.searchsorted(uid, shared_uid)
        wanted = np.unique(position)
        texts = [t if k else b"" for t, k in zip(texts, np.isin(np.arange(len(texts)), wanted))]
        keys = np.unique(position.astype(np.int64) << 40 | shared_at)
        rows: list[tuple[int, bytes]] = []
        held: list[tuple[np.ndarray, ...]] = []
        bodies: list[bytes] = []

        def send() -> None:
            r, h, at, size = map(np.concatenate, zip(*held))
            own = ids[r]
            least: dict[bytes, int] = {}
            for body, o in zip(bodies, own.tolist()):
                if least.get(body, NULL_ID) >= o:
                    least[body] = o
            state = np.array([o > least[body] for body, o in zip(bodies, own.tolist())], dtype=np.uint8)
            target = _bucket(h, buckets)
            decided = state == 1
            target[decided] = (uid[r[decided]].astype(np.uint64) >> np.uint64(17)) % np.uint64(buckets)
            number = np.arange(len(r))
            for t, c in _by_target(target, h, uid[r], own, at, size.astype(np.int32), state, number):
                body = b"".join(bodies[k] for k, s in zip(c[6].tolist(), c[5].tolist()) if not s)  # none where all are decided
                blocks = np.full(len(c[0]), block, np.int32)
                # The lower 32 bits of the hash, which an anchor's being least does not bias; contexts are compared in full.
                rows.append((t, pack_arrays(c[0].astype(np.uint32), *c[1:3], blocks, c[3].astype(np.int64), *c[4:6], np.frombuffer(body, np.uint8))))
            held.clear()
            bodies.clear()

        held_bytes = 0
        for data, starts, row, place, anchor, hashed in _windows(texts, length):
            key = row.astype(np.int64) << 40 | (place + anchor - starts)
            found = np.searchsorted(keys, key)
            hit = np.flatnonzero(keys[np.minimum(found, len(keys) - 1)] == key)
            starts, row, place, key, hashed = starts[hit], row[hit], place[hit], key[hit], hashed[hit]
            if not len(hit):
                continue
            head = _first_of_runs(key)
            head[1:] |= starts[1:] != starts[:-1] + 1
            begin = np.flatnonzero(head)
            size = np.diff(np.append(begin, len(starts))) + length - 1
            raw = data.tobytes()
            bodies += [raw[a:a + s] for a, s in zip(starts[begin].tolist(), size.tolist())]
            held.append((row[begin], hashed[begin], place[begin], size))
            held_bytes += int(size.sum())
            if held_bytes >= CONTEXT_BYTES_AT_ONCE:
                send()
                held_bytes = 0
        if held:
            send()
        return pa.Table.from_batches([_blob_batch(rows)])

    return run


def _joined(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of numbers from 0 as one column in the same order, if a word holds it."""
    widths = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    if math.prod(widths) >= WORD:
        return columns
    joined = columns[0]
    for column, width in zip(columns[1:], widths[1:]):
        joined = joined * width + column
    return (joined,)


def _sorted_places(*columns: np.ndarray) -> np.ndarray:
    """Places in ascending order of the columns; equal ones in any order."""
    return np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (numbers above 0) in order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # a place behind the end keeps the two halves of the names apart
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = _joined(padded[sample], padded[np.minimum(sample + 1, n + 2)], padded[np.minimum(sample + 2, n + 2)])
    order = _sorted_places(*triples)
    named = np.cumsum(_first_of_runs(*(t[order] for t in triples)))
    names = np.empty(len(sample), np.int64)
    names[order] = named
    if named[-1] < len(sample):
        order = suffix_order(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sample_order = sample[order]
    sample_order = sample_order[sample_order < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[_sorted_places(*_joined(padded[zeros], rank[zeros + 1]))]
    return _merge(padded, rank, zeros, sample_order, n)


def _merge(padded: np.ndarray, rank: np.ndarray, zeros: np.ndarray, sample_order: np.ndarray, n: int) -> np.ndarray:
    """Places of the sorted suffixes at 0 modulo 3 among the sorted others, counted against each class of these."""
    top = int(rank.max()) + 1
    firsts, seconds = sample_order[sample_order % 3 == 1], sample_order[sample_order % 3 == 2]
    before = np.searchsorted(padded[firsts] * top + rank[firsts + 1], padded[zeros] * top + rank[zeros + 1])
    width = int(padded.max()) + 1
    pairs_two = padded[seconds] * width + padded[seconds + 1]
    pairs_zero = padded[zeros] * width + padded[zeros + 1]
    if width * width * top >= WORD:
        _, number = np.unique(np.concatenate([pairs_two, pairs_zero]), return_inverse=True)
        pairs_two, pairs_zero = number[:len(seconds)], number[len(seconds):]
    before = before + np.searchsorted(pairs_two * top + rank[seconds + 2], pairs_zero * top + rank[zeros + 2])
    merged = np.full(n, -1, np.int64)
    merged[np.arange(len(zeros)) + before] = zeros
    merged[merged < 0] = sample_order
    return merged


def window_classes(bodies: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each body the least owner of every one of its windows among all windows that equal it."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(data), dtype=bool)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        valid[end - size:end - length + 1] = True
    order = suffix_order(data.astype(np.int64) + 1)
    order = order[valid[order]]
    owner = np.repeat(owners, sizes)[order]
    new = np.ones(len(order), dtype=bool)
    # Adjacent prefixes, eight bytes at a time; the last eight may overlap those before.
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    steps = [*range(0, length - 8, 8), length - 8]
    for a in range(1, len(order), 1 << 16):
        part = order[a - 1:a + (1 << 16)]
        differ = np.zeros(len(part) - 1, dtype=bool)
        for step in steps:
            word = eight[part + step]
            differ |= word[1:] != word[:-1]
        new[a:a + len(part) - 1] = differ
    least = np.empty(len(data), np.int64)
    if len(order):
        least[order] = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    return [least[end - size:end - length + 1] for end, size in zip(ends.tolist(), sizes.tolist())]


def _later_in_parts(bodies: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context whether each of its windows has a smaller owner too; suffixes are sorted a megabyte at a time.

    Equal windows have their anchor at the same place, so windows with ``low`` to ``high`` bytes before it are equal only if
    the bytes that all of these have, ``low`` before the anchor and ``spare - high`` behind its gram, are. Contexts are parted by
    these; where a part is still large, its windows are taken in two ranges of places, in which more bytes have to be equal.
    """
    spare = length - GRAM
    before = np.zeros(len(bodies), np.int64)  # bytes of the context before its anchor
    for _, starts, row, place, anchor, _ in _windows(bodies, length):
        head = place == 0
        before[row[head]] = (anchor - starts)[head]
    sizes = np.array([len(b) for b in bodies])
    after = sizes - before - GRAM
    data = np.frombuffer(b"".join(bodies), np.uint8)
    # Every context with its anchor in the same columns.
    grid = np.zeros((len(bodies), spare + length), np.uint8)
    owner_row = np.repeat(np.arange(len(bodies)), sizes)
    column = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[owner_row, column + (spare - before)[owner_row]] = data
    del owner_row, column
    fewest = spare - after  # bytes before the anchor in the last window of a context
    later = np.zeros((len(bodies), spare + 1), dtype=bool)  # by the bytes before the anchor

    def decide(rows: np.ndarray, low: int, high: int) -> None:
        firsts, ends = np.minimum(before[rows], high), np.maximum(fewest[rows], low)
        texts = [grid[r, spare - f:spare + length - e].tobytes() for r, f, e in zip(rows.tolist(), firsts.tolist(), ends.tolist())]
        for r, f, e, mins in zip(rows.tolist(), firsts.tolist(), ends.tolist(), window_classes(texts, owners[rows], length)):
            later[r, e:f + 1] = (mins < owners[r])[::-1]

    def solve(rows: np.ndarray, low: int, high: int) -> None:
        rows = rows[(before[rows] >= low) & (fewest[rows] <= high)]
        alike = np.ascontiguousarray(grid[rows, spare - low:spare + length - high])
        _, number, times = np.unique(alike.view(f"V{alike.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        del alike
        rows, number = rows[times[number] > 1], number[times[number] > 1]  # a context alone repeats nowhere
        order = np.argsort(number, kind="stable")
        rows, number = rows[order], number[order]
        edges = np.append(np.flatnonzero(_first_of_runs(number)), len(rows)).tolist()
        most = max(CHUNK // (spare + length), 1)
        begun = 0
        for a, b in zip(edges, edges[1:]):
            if b - a > most or b - begun > 2 * most:
                if begun < a:
                    decide(rows[begun:a], low, high)
                begun = a
            if b - a > most:
                if low == high:  # all are one window
                    later[rows[a:b], low] = owners[rows[a:b]] > owners[rows[a:b]].min()
                else:
                    half = (low + high + 1) // 2
                    solve(rows[a:b], half, high)
                    solve(rows[a:b], low, half - 1)
                begun = b
        if begun < len(rows):
            decide(rows[begun:], low, high)

    solve(np.arange(len(bodies)), 0, spare)
    return [later[k, f:b + 1][::-1] for k, (f, b) in enumerate(zip(fewest.tolist(), before.tolist()))]


def _repeats(length: int) -> Callable[[pa.Table], pa.Table]:
    """Windows that also start in a text of smaller id, by block: (uid, first start, number of starts)."""
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(d) for d in table["data"].to_pylist()]
        h, uid, ids, block, at, size, state = (np.concatenate(c) for c in list(zip(*parts))[:7])
        raw = b"".join(p[7].tobytes() for p in parts)
        found = [(uid[state == 1], at[state == 1], size[state == 1] - length + 1, block[state == 1])]
        todo = np.flatnonzero(state == 0)
        edges = np.concatenate([[0], np.cumsum(size[todo])]).tolist()
        bodies = [raw[a:b] for a, b in zip(edges, edges[1:])]
        numbers: dict[bytes, int] = {}
        code = np.array([numbers.setdefault(b, len(numbers)) for b in bodies], dtype=np.int64)
        distinct = list(numbers)
        own = ids[todo]
        least = np.full(len(distinct), NULL_ID)
        np.minimum.at(least, code, own)
        later = own > least[code]
        found.append((uid[todo][later], at[todo][later], size[todo][later] - length + 1, block[todo][later]))
        # Anchors with several different contexts: only there can a window of one equal a window of another.
        anchor = np.zeros(len(distinct), np.uint64)
        anchor[code] = h[todo]
        _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[which] > 1)
        several = several[np.argsort(which[several], kind="stable")]
        keep = ~later
        places: dict[int, list[int]] = {}
        for k in np.flatnonzero(keep & np.isin(code, several)).tolist():
            places.setdefault(int(code[k]), []).append(k)
        begun = 0
        while begun < len(several):  # whole anchors, about a megabyte at a time
            last, total = begun, 0
            while last < len(several) and (total < CHUNK or which[several[last]] == which[several[last - 1]]):
                total += len(distinct[several[last]])
                last += 1
            part = several[begun:last]
            bodies = [distinct[k] for k in part]
            later_windows = _later_in_parts(bodies, least[part], length) if total >= 2 * CHUNK else [
                mins < own for mins, own in zip(window_classes(bodies, least[part], length), least[part].tolist())]
            for k, later in zip(part.tolist(), later_windows):
                marked = np.concatenate([[False], later, [False]])
                change = np.flatnonzero(marked[1:] != marked[:-1])
                for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
                    rows = todo[places.get(k, [])]
                    found.append((uid[rows], at[rows] + a, np.full(len(rows), b - a), block[rows]))
            begun = last
        u, starts, counts, blocks = (np.concatenate(c) for c in zip(*found))
        rows = [(t, pack_arrays(*c)) for t, c in _by_target(blocks, u, starts.astype(np.int64), counts.astype(np.int64))]
        return pa.Table.from_batches([_blob_batch(rows)])

    return run


def _keyed(docs: DataFrame, blocks: int) -> DataFrame:
    uid = F.xxhash64(F.col("doc_id").cast("long"), whole_text())
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), uid.alias("_uid"),
                       F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int").alias("_block"), whole_text().alias("_text"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(begin, ROWS_AT_ONCE)
            packed = pa.array(map(pack.compress, part.column("_text").cast(pa.binary()).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["_id", "_uid", "_block", "_packed"])


class Repeats:
    """The repeated windows of a table of documents, found once and applied as asked."""

    def __init__(self, docs: DataFrame, length: int = LENGTH) -> None:
        if length < 2 * GRAM:
            raise ValueError(f"length must be {2 * GRAM} or more")
        self.docs, self.length = docs, length
        total = docs.select(F.sum(F.octet_length(whole_text())).alias("n")).first()["n"] or 0
        self.blocks = max(1, -(-total // BUCKET_BYTES))
        keyed = _keyed(docs, self.blocks)
        self.texts = keyed.mapInArrow(_packed, "_id long, _uid long, _block int, _packed binary")
        anchors = keyed.mapInArrow(_send_anchors(self.blocks, length), BLOB)
        shared = anchors.groupBy("target").applyInArrow(_shared_anchors, BLOB)
        contexts = self.texts.groupBy("_block").cogroup(shared.groupBy("target")).applyInArrow(
            _send_contexts(self.blocks, length), BLOB)
        self.windows = contexts.groupBy("target").applyInArrow(_repeats(length), BLOB)

    def summary(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
        length = self.length

        def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
            unpack = zstandard.ZstdDecompressor()
            marks, rows = _marks(blobs), []
            for own, uid, packed in zip(*(docs[c].to_pylist() for c in ("_id", "_uid", "_packed"))):
                text = unpack.decompress(packed)
                kept, spans = remove(text, marks.get(uid), length)
                rows.append((None if own == NULL_ID else own, len(text), len(text) - len(kept), spans,
                             hashlib.sha256(kept).hexdigest()))
            kinds = (*[pa.int64()] * 4, pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

        return self.texts.groupBy("_block").cogroup(self.windows.groupBy("target")).applyInArrow(
            run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def applied(self) -> DataFrame:
        """All columns of the documents, ``text`` without the repeated bytes (a character cut in two goes as a whole)."""
        length, names = self.length, self.docs.columns
        # The row travels in a struct, so that none of its columns can clash with the keys.
        keyed = self.docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), whole_text()).alias("_uid"))
        keyed = keyed.withColumn("_block", F.pmod(F.xxhash64("_uid"), F.lit(self.blocks)).cast("int"))

        def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
            marks = _marks(blobs)
            columns = dict(zip(names, docs["row"].combine_chunks().flatten())) if docs.num_rows else {
                n: pa.array([], docs.schema.field("row").type.field(n).type) for n in names}
            texts = [t if t is None or u not in marks else
                     remove(t.encode("utf-8", "replace"), marks[u], length)[0].decode("utf-8", "ignore")
                     for t, u in zip(columns["text"].to_pylist(), docs["_uid"].to_pylist())]
            columns["text"] = pa.array(texts, columns["text"].type)
            return pa.table(list(columns.values()), names=list(columns))

        return keyed.groupBy("_block").cogroup(self.windows.groupBy("target")).applyInArrow(run, self.docs.schema)


def _marks(blobs: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if not blobs.num_rows:
        return {}
    uid, start, count = _gathered(blobs)
    order = np.argsort(uid, kind="stable")
    uid, start, count = uid[order], start[order], count[order]
    cuts = np.flatnonzero(_first_of_runs(uid))
    return {int(uid[a]): (start[a:b], count[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(uid)))}


def remove(text: bytes, marked: tuple[np.ndarray, np.ndarray] | None, length: int) -> tuple[bytes, int]:
    """What is left of ``text`` without the bytes its marked windows cover, and the number of removed runs."""
    if marked is None:
        return text, 0
    start, count = marked
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans
