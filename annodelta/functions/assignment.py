"""Maximum-weight bipartite matching of one weight matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

#: Among matchings of equal total the one of largest total tie value counts; a tie value has so many bits.
TIE_BITS = 24


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of maximum total weight; weights of 0 mean no edge.

    Shortest augmenting paths with dual prices. Ties go to the smaller index, so the result is
    the same on every run. Integer weights are summed as integers.
    """
    n, m = weights.shape
    if n == 0 or m == 0:
        return []
    if n > m:
        return sorted((i, j) for j, i in best_assignment(weights.T))
    favourite = weights.argmax(axis=1)
    if len(np.unique(favourite)) == n:  # nobody competes: every row gets its best column
        return [(i, int(j)) for i, j in enumerate(favourite) if weights[i, j] > 0]

    kind = weights.dtype
    beyond = np.iinfo(kind).max if np.issubdtype(kind, np.integer) else np.inf
    cost = weights.max() - weights
    row_price, column_price = np.zeros(n, kind), np.zeros(m, kind)
    owner = np.full(m, -1)
    for row in range(n):
        reach = cost[row] - row_price[row] - column_price
        came_from = np.full(m, -1)
        settled = np.zeros(m, dtype=bool)
        while True:
            column = int(np.argmin(np.where(settled, beyond, reach)))
            settled[column] = True
            if owner[column] < 0:
                break
            holder = owner[column]
            through = reach[column] + cost[holder] - row_price[holder] - column_price
            shorter = ~settled & (through < reach)
            reach[shorter] = through[shorter]
            came_from[shorter] = column
        slack = reach[column] - reach
        held = settled & (owner >= 0)
        row_price[row] += reach[column]
        row_price[owner[held]] += slack[held]
        column_price[settled] -= slack[settled]
        while column >= 0:
            before = came_from[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0 and weights[i, j] > 0)


def tie_value(row: str, column: str) -> int:
    """A fixed number for a pair of names, the same wherever the pair is met."""
    return int(hashlib.md5(f"{row}\t{column}".encode()).hexdigest()[:TIE_BITS // 4], 16)


def unique_assignment(units: np.ndarray, rows: Sequence[str], columns: Sequence[str]) -> list[tuple[int, int]]:
    """The matching of largest total of integer weights, and among those the one of largest total tie value.

    So the result depends on the weights and names alone, not on the order or the method of the search.
    Weights are below 2 ** 21 and the shorter side below 2 ** 16.
    """
    n, m = units.shape
    if n == 0 or m == 0:
        return []
    by_row = units if n <= m else units.T
    best = by_row.max(axis=1)
    if (((by_row == best[:, None]).sum(axis=1) == 1) | (best == 0)).all():
        wanted = by_row.argmax(axis=1)[best > 0]
        if len(np.unique(wanted)) == len(wanted):  # every row has one favourite, and no two the same
            pairs = [(int(i), int(j)) for i, j in zip(np.flatnonzero(best > 0), wanted)]
            return pairs if n <= m else sorted((i, j) for j, i in pairs)
    weights = units.astype(np.int64) << (TIE_BITS + min(n, m).bit_length())
    for i, j in zip(*np.nonzero(units)):
        weights[i, j] += tie_value(rows[i], columns[j])
    return best_assignment(weights)
