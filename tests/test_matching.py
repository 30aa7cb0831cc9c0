import itertools
import random

import numpy as np
import pytest

from annodelta.operators import matching, regions
from annodelta.functions.assignment import tie_value, unique_assignment
from annodelta.operators.auction import match_exactly
from annodelta.operators.components import linked_components

TX = "contig string, fwd boolean, transcript_id string, start long, end long"
FEATURE = "contig string, transcript_id string, type string, start long, end long, fwd boolean, ord int"


def release(spark, seed, prefix, n):
    rng = random.Random(seed)
    transcripts, features = [], []
    for k in range(n):
        at, children = rng.randint(1000, 1400), []
        for _ in range(rng.randint(1, 4)):
            size = rng.choice([50, 80, 120])
            children += [("exon", at, at + size), ("CDS", at + 5, at + size)][:rng.randint(1, 2)]
            at += size + rng.choice([40, 90])
        rng.shuffle(children)
        name, fwd = f"{prefix}{k}", k % 5 != 4
        transcripts.append(("1", fwd, name, min(c[1] for c in children), max(c[2] for c in children)))
        features += [("1", name, *c, fwd, i) for i, c in enumerate(children)]
    return spark.createDataFrame(transcripts, TX), spark.createDataFrame(features, FEATURE)


@pytest.mark.parametrize("most", [1, 10])
def test_every_way_finds_the_same_matching(spark, monkeypatch, most):
    (t, tf), (q, qf) = release(spark, 1, "t", 7), release(spark, 2, "q", 9)
    exact = matching.match_transcripts(t, q, tf, qf).collect()
    assert len({r.target_transcript_id for r in exact}) == len({r.query_transcript_id for r in exact}) == len(exact) > 5
    monkeypatch.setattr(matching, "MAX_CELLS_PER_LOCUS", most)
    monkeypatch.setattr(matching, "PART_TRANSCRIPTS", 3)
    assert sorted(map(tuple, matching.match_transcripts(t, q, tf, qf).collect())) == sorted(map(tuple, exact))


def test_reciprocal_hits_do_not_depend_on_the_parts(spark, monkeypatch):
    (t, tf), (q, qf) = release(spark, 1, "t", 7), release(spark, 2, "q", 9)
    whole = sorted(map(tuple, matching.reciprocal_model_hits(t, q, tf, qf).collect()))
    assert len({r[3] for r in whole}) == len({r[4] for r in whole}) == len(whole) > 2
    monkeypatch.setattr(matching, "MAX_CELLS_PER_LOCUS", 10)
    monkeypatch.setattr(matching, "PART_TRANSCRIPTS", 3)
    assert sorted(map(tuple, matching.reciprocal_model_hits(t, q, tf, qf).collect())) == whole
    same = matching.reciprocal_model_hits(t, t, tf, tf).collect()
    assert same and all(r.score >= 0.5 for r in same)  # each has its own chain at least


def _best_by_enumeration(units):
    """The pairs of largest total, then of largest total tie value, over all one-to-one choices."""
    n, m = 4, 5
    best = max(
        (sum(units.get((i, j), 0) for i, j in chosen), sum(tie_value(f"t{i}", f"q{j}") for i, j in chosen), chosen)
        for order in itertools.permutations(range(m), n)
        for chosen in [sorted((i, j) for i, j in enumerate(order) if (i, j) in units)])
    return best[2]


@pytest.mark.parametrize("seed", range(2))
def test_exact_with_many_ties(spark, seed):
    rng = random.Random(seed)
    units = {(i, j): rng.choice([100_000, 100_000, 200_000, 700_001]) for i in range(4) for j in range(5) if rng.random() < 0.8}
    expected = _best_by_enumeration(units)
    table = np.zeros((4, 5), dtype=np.int64)
    for (i, j), w in units.items():
        table[i, j] = w
    assert unique_assignment(table, [f"t{i}" for i in range(4)], [f"q{j}" for j in range(5)]) == expected
    pairs = spark.createDataFrame([("1", f"t{i}", f"q{j}", w) for (i, j), w in units.items()],
                                  "contig string, target_transcript_id string, query_transcript_id string, units long")
    found = match_exactly(pairs).collect()
    assert sorted((int(r.target_transcript_id[1:]), int(r.query_transcript_id[1:])) for r in found) == expected


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (102, 101)] + [(200 + k, 250) for k in range(20)]
    random.Random(1).shuffle(chain)
    found = dict(linked_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 104)}, **{k: 200 for k in range(200, 220)}, 250: 200}


def test_matching_of_identical_releases_is_the_identity(spark):
    t, tf = release(spark, 5, "x", 8)
    rows = matching.match_transcripts(t, t, tf, tf).collect()
    assert sum(r.score for r in rows) == pytest.approx(1.45 * 8, abs=1.7)
    assert len(rows) == 8


@pytest.mark.parametrize("most", [4_000_000, 1])
def test_transcripts_without_children_are_matched(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MAX_CELLS_PER_LOCUS", most)
    (t, tf), (q, qf) = release(spark, 6, "t", 2), release(spark, 7, "q", 2)
    bare = [("2", True, "bare", 100, 900), ("1", True, "also", 1000, 1600)]
    t, q = t.unionByName(spark.createDataFrame(bare, TX)), q.unionByName(spark.createDataFrame(bare, TX))
    found = {(r.target_transcript_id, r.query_transcript_id): r.score for r in matching.match_transcripts(t, q, tf, qf).collect()}
    # No shared model, equal (empty) chains, equal ends and midpoints.
    assert found["bare", "bare"] == pytest.approx(0.2 + 0.55 + 0.5)
    assert "also" in {a for a, _ in found} and "also" in {b for _, b in found}
    pair = spark.createDataFrame([("2", "bare", "bare")], "contig string, target_transcript_id string, query_transcript_id string")
    assert [(r.jaccard, r.chain) for r in matching.compare_models(pair, tf, qf).collect()] == [(0.0, 1.0)]


def test_pair_without_regions_is_reported(spark):
    pair = spark.createDataFrame([("1", "a", "b")], "contig string, target_transcript_id string, query_transcript_id string")
    none = spark.createDataFrame([], FEATURE)
    assert [(r.type, r.t_start, r.absent) for r in regions.pair_regions(pair, none, none).collect()] == [("exon", None, "QUERY")]
    one = spark.createDataFrame([("1", "b", "exon", 5, 9, False, 0)], FEATURE)
    assert [(r.type, r.t_start, r.q_start) for r in regions.pair_regions(pair, none, one, ["exon"]).collect()] == [("exon", None, 5)]
