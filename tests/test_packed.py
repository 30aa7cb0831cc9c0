"""Children travel as one row per transcript and come back whole and in order."""

import numpy as np

from annodelta.annotation import Annotation, with_introns
from annodelta.functions import scoring
from annodelta.operators import matching, regions, statistics
from tests.test_shuffles import COLUMNS, _dealt, _features, _shuffles


def _rows(t, spans):
    return [("c", "G", t, kind, start, end, True, n) for n, (kind, start, end) in enumerate(spans)]


def test_children_are_one_row_a_transcript(spark):
    far = 1 << 33
    spans = {"T1": [("exon", 50, 60), ("CDS", 52, 60), ("exon", 10, 20), ("intron", 21, 49)], "T2": [("exon", 5, 9), ("exon", far, far + 3)]}
    features = spark.createDataFrame([r for t, s in spans.items() for r in _rows(t, s)], COLUMNS)
    children = matching._children(features)
    assert children.count() == 2
    found = {t: [] for t in spans}
    for r in matching._unfolded(children).sort("transcript_id", "ord").collect():
        found[r.transcript_id].append((r.child_start, r.child_end, r.code))
    assert found == {"T1": [(50, 60, -1), (52, 60, 2), (10, 20, -1), (21, 49, 4)], "T2": [(5, 9, -1), (far, far + 3, -1)]}


def test_a_pair_listed_twice_has_its_regions_twice(spark):
    features = _features(spark).where("transcript_id = 'T1' and type = 'exon' and ord < 2")
    one = spark.createDataFrame([("c", "T1", "T1")], "contig string, target_transcript_id string, query_transcript_id string")
    single = regions.pair_regions(one, features, features, ["exon"]).collect()
    assert sorted((r.t_start, r.q_start) for r in single) == [(100, 100), (110, 110)]
    double = regions.pair_regions(one.unionAll(one), features, features, ["exon"]).collect()
    assert sorted(r.t_start for r in double) == [100, 100, 110, 110]


def test_dealt_children_need_no_shuffle(spark):
    assert _shuffles(matching._children(_dealt(_features(spark)))) == 1  # the dealing itself


def test_models_compared_together_score_as_one_by_one():
    random = np.random.default_rng(3)
    frames, expected = [], []
    for pair in range(300):
        sides = []
        for side in (0, 1):
            n = 60 if pair == 7 else int(random.integers(0, 9))
            starts = random.integers(1, 40, n)
            sides.append((starts, starts + random.integers(0, 15, n), random.choice([-1, -1, 0, 1, 2, 4], n)))
            frames.append((np.full(n, 2 * pair + side), *sides[-1]))
        if pair % 3 == 0 and pair != 7:  # equal models too
            frames[-1] = (np.full(len(sides[0][0]), 2 * pair + 1), *sides[0])
            sides[1] = sides[0]
        cuts = scoring.cut_points(*[x[:2] for x in sides])
        painted = [scoring.paint(*x, cuts)[None] for x in sides]
        exons = [(s, e) for s, e in ((x[0][x[2] == -1], x[1][x[2] == -1]) for x in sides)]
        chains = [(e - s + 1)[np.argsort(s, kind="stable")] for s, e in exons]
        expected.append((scoring.jaccards(*painted, np.ones(max(len(cuts) - 1, 0)))[0, 0],
                         scoring.chain_similarities([chains[0]], [chains[1]])[0, 0]))
    side, starts, ends, codes = (np.concatenate(c) for c in zip(*frames))
    for cells in (scoring.CELLS_AT_ONCE, 40):  # also in small pieces
        held, scoring.CELLS_AT_ONCE = scoring.CELLS_AT_ONCE, cells
        try:
            exons = np.flatnonzero(codes == -1)
            exons = exons[np.lexsort((starts[exons], side[exons]))]
            found = zip(scoring.paired_jaccards(side, starts, ends, codes, 300), scoring.paired_chains(side[exons], (ends - starts + 1)[exons], 300))
            assert list(found) == expected
        finally:
            scoring.CELLS_AT_ONCE = held


def test_introns_take_one_sort(spark):
    plan = with_introns(Annotation(None, None, _dealt(_features(spark)))).features._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Sort [") == 1


def test_lengths_with_introns_are_those_of_the_whole_annotation(spark):
    features = spark.createDataFrame(_rows("T1", [("exon", 50, 60), ("exon", 10, 20), ("CDS", 52, 58)]) + _rows("T2", [("exon", 1, 9)]), COLUMNS)
    transcripts = spark.createDataFrame([("c", "G", "T1", None, None), ("c", "G", "T2", 1, 9)], "contig string, gene_id string, transcript_id string, start long, end long")
    genes = spark.createDataFrame([("c", "G", 1, 60)], "contig string, gene_id string, start long, end long")
    annotation = Annotation(genes, transcripts, features)
    found = statistics.lengths(annotation, introns=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, statistics.lengths(with_introns(annotation)).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
