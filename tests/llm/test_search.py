from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from annodelta.llm import search


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_force(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms_of(text))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            rows.append((item, rank, i, -score))
    return rows


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.fixture(scope="module")
def many():
    """Families of copies, common and rare words, long and short texts."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[min(399, int(draw.paretovariate(0.6)))] for _ in range(draw.choice([1, 5, 40, 300])))) for k in range(500)]
    docs += [(1000 + k, "same words in every copy w3 w5") for k in range(300)]
    items = [(k, " ".join(draw.sample(words, 12)) + " W1 w2") for k in range(30)] + [(50, "copy w5 w3"), (51, "nowhere found"), (52, "")]
    return docs, items


@pytest.mark.parametrize("forced", [{}, {"BLOCK_DOCS": 7, "LEAF_DOCS": 2, "BLOCK_ITEMS": 4}, {"GROUP_BYTES": 900, "BLOCK_ENTRIES": 50}])
def test_against_brute_force(spark, many, monkeypatch, forced):
    for name, value in forced.items():
        monkeypatch.setattr(search, name, value)
    docs, items = many
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                          spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(found.collect()) == in_order(brute_force(docs, items))


def test_awkward_rows(spark, docs, rows, empty):
    items = [(1, "Alpha gamma MIT"), (1, "beta fox"), (None, "potion"), (2, None), (3, "日本語のテキスト"), (4, "word1x1 é"), (5, "a" * 700)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    found = search.search(docs, table).collect()
    assert in_order(found) == in_order(brute_force([(i, t) for i, t, _ in rows], items))
    assert search.search(empty, table).count() == 0
    assert search.search(docs, table.where("false")).count() == 0


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(3)
    n, width = 600, 200
    docs = [np.unique(np.concatenate([draw.integers(20 * (k % 9), 20 * (k % 9) + 20, 12), draw.integers(190, 200, 3)])) for k in range(n)]
    sizes, cols = np.array([len(d) for d in docs]), np.concatenate(docs)
    weights = np.where(np.arange(width) < 190, draw.integers(2000, 9000, width), 50)
    values = draw.integers(1, 900_000, len(cols))
    groups = np.arange(width) // 5
    tree = search.BallTree(sizes, cols, values, weights, groups, 16)
    query = np.where((np.arange(width) % 20 < 6) & (np.arange(width) // 20 == 3), weights, 0)
    norms = search.group_norms(query[None], groups)
    bounds = tree.bounds(np.sqrt(query)[None], norms)[:, 0]
    exact = np.array([(query[c] * v).sum() for c, v in zip(np.split(cols, np.cumsum(sizes)[:-1]), np.split(values, np.cumsum(sizes)[:-1]))])
    for node, (low, high) in enumerate(tree.spans):
        assert exact[tree.order[low:high]].max() <= bounds[node]
    best = search.Best(10)
    leaves = search.search_tree(tree, bounds, query, np.arange(n), np.zeros(n, bool), best)
    assert [-s for s, _, _ in best.rows] == sorted(exact, reverse=True)[:10]
    assert leaves < sum(not c for c in tree.children) / 3
