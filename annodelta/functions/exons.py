"""Pairing the exons, inner regions and introns of two transcripts.

Works on plain arrays of one transcript pair; lists are bounded by the size of a transcript.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from annodelta import constants as C

Pairing = list[tuple[int | None, int | None]]


@dataclass
class Spans:
    """Start and end positions of a list of regions."""

    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def take(self, index) -> Spans:
        return Spans(self.start[index], self.end[index])


def along_strand(exons: Spans, forward: bool) -> Spans:
    """Exons sorted by start, turned round for the reverse strand."""
    return exons if forward else exons.take(slice(None, None, -1))


def aligned_gaps(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs matched by the global alignment of two gap-length lists.

    A match costs the capped length difference, a skipped gap a fixed penalty. Among equal scores
    a match is preferred, then skipping in ``a``, then in ``b``.
    """
    n, m = len(a), len(b)
    ramp = C.GAP_PENALTY * np.arange(m + 1)
    score = np.empty((n + 1, m + 1), dtype=np.int64)
    score[0] = -ramp
    match = -np.minimum(np.abs(a[:, None] - b[None, :]), C.GAP_DELTA_CAP)
    for i in range(1, n + 1):
        best = score[i - 1] - C.GAP_PENALTY
        best[1:] = np.maximum(best[1:], score[i - 1, :-1] + match[i - 1])
        score[i] = np.maximum.accumulate(best + ramp) - ramp
    pairs = []
    i, j = n, m
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + match[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif score[i, j] == score[i - 1, j] - C.GAP_PENALTY:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def typical_shift(shifts: list[int]) -> int:
    """Median shift, 0 while fewer than two are known; halves are cut towards zero."""
    if len(shifts) < 2:
        return 0
    ordered = sorted(shifts)
    mid = len(ordered) // 2
    return ordered[mid] if len(ordered) % 2 else int((ordered[mid - 1] + ordered[mid]) / 2)


@dataclass
class _Pool:
    """Exons still to be paired, with the tables the choices are made from."""

    target: Spans
    query: Spans
    pairs: Pairing = field(default_factory=list)
    shifts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        t_len, q_len = self.target.end - self.target.start + 1, self.query.end - self.query.start + 1
        self.difference = np.abs(t_len[:, None] - q_len[None, :])
        share = self.difference / np.maximum(t_len[:, None], q_len[None, :])
        self.similar = (self.difference <= C.LENGTH_CAP_BP) | (share <= C.LENGTH_CAP_SHARE)
        self.start_shift = self.target.start[:, None] - self.query.start[None, :]
        self.end_shift = self.target.end[:, None] - self.query.end[None, :]
        self.free_t = np.ones(len(self.target), dtype=bool)
        self.free_q = np.ones(len(self.query), dtype=bool)

    def choose(self, rows, columns, shift: int) -> bool:
        """Pair the most similar free exons among the candidates, if any are similar enough."""
        rows = [i for i in rows if self.free_t[i]]
        columns = [j for j in columns if self.free_q[j]]
        options = [
            (self.difference[i, j], abs(self.start_shift[i, j] - shift) + abs(self.end_shift[i, j] - shift), i, j)
            for i in rows for j in columns if self.similar[i, j]
        ]
        if not options:
            return False
        _, _, i, j = min(options)
        self.pairs.append((int(i), int(j)))
        self.shifts.append(int(self.start_shift[i, j]))
        self.free_t[i] = self.free_q[j] = False
        return True

    def choose_for(self, row: int, shift: int) -> bool:
        """Vector form of :meth:`choose` for one target exon against all free query exons."""
        allowed = np.flatnonzero(self.similar[row] & self.free_q)
        if not len(allowed):
            return False
        distance = np.abs(self.start_shift[row, allowed] - shift) + np.abs(self.end_shift[row, allowed] - shift)
        j = allowed[np.lexsort((distance, self.difference[row, allowed]))[0]]
        self.pairs.append((row, int(j)))
        self.shifts.append(int(self.start_shift[row, j]))
        self.free_t[row] = self.free_q[j] = False
        return True


def pair_exons(target: Spans, query: Spans) -> Pairing:
    """Pair exons given along the strand; a missing partner is None.

    Matched gaps propose the exons beside them. What stays free is paired from the last exon
    backwards once, then exon by exon, preferring equal length and the shift seen so far.
    """
    if len(target) == len(query) and (
        len(target) == 1 or (np.array_equal(target.start, query.start) and np.array_equal(target.end, query.end))
    ):
        return [(i, i) for i in range(len(target))]

    pool = _Pool(target, query)
    if min(len(target), len(query)) < 2:
        pairs: Pairing = []
        for i in range(len(target)):
            pairs.append(pool.pairs[-1] if pool.choose_for(i, 0) else (i, None))
        return pairs + [(None, int(j)) for j in np.flatnonzero(pool.free_q)]

    t_gaps = target.start[1:] - target.end[:-1] - 1
    q_gaps = query.start[1:] - query.end[:-1] - 1
    for k, l in aligned_gaps(t_gaps, q_gaps):
        pool.choose((k, k + 1), (l, l + 1), typical_shift(pool.shifts))
    if pool.free_t.any() and pool.free_q.any():
        pool.choose(np.flatnonzero(pool.free_t)[-1:], np.flatnonzero(pool.free_q)[-1:], 0)
    shift = typical_shift(pool.shifts)
    for i in np.flatnonzero(pool.free_t):
        pool.choose_for(int(i), shift)
    return (
        pool.pairs
        + [(int(i), None) for i in np.flatnonzero(pool.free_t)]
        + [(None, int(j)) for j in np.flatnonzero(pool.free_q)]
    )


def _inside(regions: Spans, exons: Spans, pick: list[int | None]) -> np.ndarray:
    """Table (region, rank): whether the region lies in the exon picked at that rank."""
    known = np.array([i is not None for i in pick], dtype=bool)
    index = np.array([i or 0 for i in pick], dtype=np.int64)
    if not len(exons) or not len(regions):
        return np.zeros((len(regions), len(pick)), dtype=bool)
    return (
        (regions.start[:, None] >= exons.start[index] - C.CONTAINMENT_PAD_BP)
        & (regions.end[:, None] <= exons.end[index] + C.CONTAINMENT_PAD_BP)
        & known
    )


def pair_inner_regions(t_exons: Spans, q_exons: Spans, exon_pairs: Pairing, target: Spans, query: Spans) -> Pairing:
    """Pair regions of one type lying in paired exons, nearest ends first come first served.

    A target region outside every exon is not reported; a query region without partner is.
    """
    waiting: dict[int, list[int]] = {}
    held = _inside(query, q_exons, [j for _, j in exon_pairs])
    for j in np.flatnonzero(held.any(axis=1)).tolist():
        waiting.setdefault(int(held[j].argmax()), []).append(j)
    t_start, t_end, q_start, q_end = (x.tolist() for x in (target.start, target.end, query.start, query.end))
    pairs: Pairing = []
    used = set()
    ranks, rows = np.nonzero(_inside(target, t_exons, [i for i, _ in exon_pairs]).T)
    for rank, r in zip(ranks.tolist(), rows.tolist()):
        partner = min(
            (j for j in waiting.get(rank, ()) if j not in used),
            key=lambda j: abs(q_start[j] - t_start[r]) + abs(q_end[j] - t_end[r]), default=None,
        )
        used.add(partner)
        pairs.append((r, partner))
    return pairs + [(None, j) for j in range(len(query)) if j not in used]


class _Introns:
    """Finds the longest intron of a transcript inside a gap between two of its exons."""

    def __init__(self, exons: Spans, introns: Spans) -> None:
        self.exons = list(zip(exons.start.tolist(), exons.end.tolist()))
        self.introns = list(zip(introns.start.tolist(), introns.end.tolist()))
        self.exact: dict[tuple[int, int], int] = {}
        for k, span in enumerate(self.introns):
            self.exact.setdefault(span, k)

    def between(self, a: int, b: int) -> int | None:
        low, high = sorted((self.exons[a], self.exons[b]))
        first, last = low[1] + 1, high[0] - 1
        if last < first:
            return None
        if (first, last) in self.exact:
            return self.exact[first, last]
        inside = [k for k, (s, e) in enumerate(self.introns) if s >= first and e <= last]
        return max(inside, key=lambda k: self.introns[k][1] - self.introns[k][0], default=None)


def pair_introns(
    t_exons: Spans, q_exons: Spans, exon_pairs: Pairing, target: Spans, query: Spans,
    forward: bool = True, reverse_unpaired: bool = False,
) -> Pairing:
    """Pair introns between neighbouring exons whose partners are neighbours in the same order.

    ``reverse_unpaired`` leaves all introns of reverse-strand transcripts without partner.
    """
    partner = {i: j for i, j in exon_pairs if i is not None and j is not None}
    t_introns, q_introns = _Introns(t_exons, target), _Introns(q_exons, query)
    pairs: Pairing = []
    for i in range(len(t_exons) - 1):
        left, right = partner.get(i), partner.get(i + 1)
        if left is None or right is None or right != left + 1 or (reverse_unpaired and not forward):
            continue
        found = (t_introns.between(i, i + 1), q_introns.between(left, right))
        if found != (None, None):
            pairs.append(found)
    seen_t, seen_q = {i for i, _ in pairs}, {j for _, j in pairs}
    return (
        pairs
        + [(i, None) for i in range(len(target)) if i not in seen_t]
        + [(None, j) for j in range(len(query)) if j not in seen_q]
    )
