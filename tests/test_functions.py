import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annodelta.functions import exons as X
from annodelta.functions import alignment, scoring
from annodelta.functions.alignment import align, align_many, edit_distance, edit_distances
from annodelta.functions.assignment import best_assignment


def plain_chain_distance(a, b):
    table = [[2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 2, table[i][j - 1] + 2, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


lists = st.lists(st.integers(1, 5), max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.lists(lists, min_size=1, max_size=4), st.lists(lists, min_size=1, max_size=4))
def test_chain_similarity_equals_plain_table(first, second):
    found = scoring.chain_similarities([np.array(a, dtype=int) for a in first], [np.array(b, dtype=int) for b in second])
    for i, a in enumerate(first):
        for j, b in enumerate(second):
            longest = max(len(a), len(b))
            expected = 1.0 - plain_chain_distance(a, b) / longest if longest else 1.0
            assert found[i, j] == pytest.approx(expected)


def test_chain_similarity_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    a = [rng.integers(1, 9, rng.integers(0, 6)) for _ in range(9)]
    b = [rng.integers(1, 9, rng.integers(0, 6)) for _ in range(5)]
    whole = scoring.chain_similarities(a, b)
    monkeypatch.setattr(scoring, "CELLS_AT_ONCE", 60)
    assert np.array_equal(whole, scoring.chain_similarities(a, b))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    rng = np.random.default_rng(seed)
    weights = np.where(rng.random((n, m)) < 0.3, 0.0, rng.integers(1, 6, (n, m)) / 4)
    pairs = best_assignment(weights)
    assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
    assert all(weights[i, j] > 0 for i, j in pairs)
    small, big = (weights, range(m)) if n <= m else (weights.T, range(n))
    best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(big, min(n, m)))
    assert sum(weights[i, j] for i, j in pairs) == pytest.approx(best)


def test_paint_gives_the_first_listed_child():
    starts, ends = np.array([1, 5, 1]), np.array([10, 20, 30])
    cuts = scoring.cut_points((starts, ends))
    assert scoring.paint(starts, ends, np.array([-1, 2, 4]), cuts).tolist() == [0, 0, 2, 4]
    assert cuts.tolist() == [1, 5, 11, 21, 31]


def spans(*pairs):
    return X.Spans(np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int))


def test_single_exons_pair_whatever_their_length():
    assert X.pair_exons(spans((1, 10)), spans((500, 9000))) == [(0, 0)]


def test_one_side_without_gaps_takes_the_most_similar_exon():
    assert X.pair_exons(spans((100, 199)), spans((10, 59), (110, 209), (400, 999))) == [(0, 1), (None, 0), (None, 2)]


def test_dissimilar_lengths_stay_unpaired():
    assert X.pair_exons(spans((1, 1000)), spans((1, 100), (200, 260))) == [(0, None), (None, 0), (None, 1)]


def test_inserted_exon_is_the_only_one_missing():
    target = spans((100, 200), (1000, 1100), (3000, 3100))
    query = spans((100, 200), (500, 900), (1000, 1100), (3000, 3100))
    pairs = set(X.pair_exons(target, query))
    assert pairs == {(0, 0), (1, 2), (2, 3), (None, 1)}


def test_shift_is_cut_towards_zero():
    assert [X.typical_shift(s) for s in ([7], [-3, 2], [1, 2], [5, 1, 9])] == [0, 0, 1, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(20, 900)), max_size=6),
       st.lists(st.tuples(st.integers(1, 400), st.integers(20, 900)), max_size=6), st.booleans())
def test_every_exon_is_reported_exactly_once(first, second, forward):
    def build(parts):
        at, out = 0, []
        for gap, size in parts:
            out.append((at + gap, at + gap + size))
            at += gap + size
        return X.along_strand(spans(*out), forward)

    t, q = build(first), build(second)
    pairs = X.pair_exons(t, q)
    assert sorted(i for i, _ in pairs if i is not None) == list(range(len(t)))
    assert sorted(j for _, j in pairs if j is not None) == list(range(len(q)))


def test_inner_regions_take_the_nearest_free_partner():
    exons = spans((100, 300))
    pairs = X.pair_inner_regions(exons, exons, [(0, 0)], spans((100, 150), (160, 300)), spans((165, 300), (90, 150), (400, 410)))
    assert pairs == [(0, 1), (1, 0), (None, 2)]


@pytest.mark.parametrize("forward", [True, False])
def test_introns_pair_on_both_strands(forward):
    exons = X.along_strand(spans((1, 10), (21, 30), (41, 50)), forward)
    introns = spans((11, 20), (31, 40))
    paired = X.pair_introns(exons, exons, [(0, 0), (1, 1), (2, 2)], introns, introns, forward)
    assert sorted(paired) == [(0, 0), (1, 1)]
    quirk = X.pair_introns(exons, exons, [(0, 0), (1, 1), (2, 2)], introns, introns, forward, reverse_unpaired=True)
    assert len(quirk) == (2 if forward else 4)


@settings(max_examples=100, deadline=None)
@given(st.text("ACGT", max_size=20), st.text("ACGT", max_size=20))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    assert edit_distance(a, b) == row[-1]


def test_alignment_of_an_edited_copy():
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(2000))
    edited = text[:500] + text[503:900] + "TTTT" + text[900:1500] + ("A" if text[1500] != "A" else "C") + text[1501:]
    q, t, edits, columns = align(edited, text)
    assert (q, t) == (len(edited), len(text))
    assert edits == 8
    assert 1 - edits / columns > 0.99


def test_alignment_leaves_foreign_ends_out():
    rng = random.Random(4)
    core, left, right = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (1000, 300, 300))
    q, t, edits, _ = align(left + core, core + right)
    assert abs(q - 1000) < 15 and abs(t - 1000) < 15 and edits < 5


def _edited(rng, text, share):
    out = []
    for letter in text:
        if rng.random() < share:
            out.append(rng.choice(["", letter + rng.choice("acgt"), rng.choice("acgt")]))
        else:
            out.append(letter)
    return "".join(out)


def test_batch_alignment_is_the_single_one():
    rng = random.Random(11)
    pairs = [("", ""), ("a", ""), ("", "acgt"), ("acgt" * 30, "acgt" * 31), ("é" * 40 + "x", "x" + "é" * 40), ("abc", "abd")]
    for k in range(150):
        text = "".join(rng.choice("acgt" if k % 3 else "acgtéß語😀 ") for _ in range(rng.choice([5, 40, 300, 900])))
        other = _edited(rng, text, rng.choice([0.0, 0.02, 0.1, 0.5]))
        if k % 5 == 0:  # blocks changed round, so that anchors do not rise
            cut = len(text) // 3
            other = text[cut:2 * cut] + text[:cut] + _edited(rng, text[2 * cut:], 0.05)
        if k % 7 == 0:
            other = "".join(rng.choice("acgt") for _ in range(30)) + other + text[:20]
        pairs.append((text, other))
    queries, targets = map(list, zip(*pairs))
    assert align_many(queries, targets).tolist() == [list(align(q, t)) for q, t in pairs]
    assert align_many(queries, targets, 4).tolist() == [list(align(q, t, 4)) for q, t in pairs]
    assert align_many([], []).shape == (0, 4)


def test_edit_distances_side_by_side(monkeypatch):
    rng = random.Random(12)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 3, 63, 64, 65, 130]))),
              "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 5, 64, 90])))) for _ in range(300)]
    expected = [edit_distance(a, b) for a, b in pairs]
    assert edit_distances(pairs).tolist() == expected
    monkeypatch.setattr(alignment, "SHORT_AT_ONCE", 7)
    assert edit_distances(pairs).tolist() == expected
