"""Features as one list per transcript of both releases give what features as rows give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annodelta.annotation import PART, Annotation, join_by_transcript, transcript_extents, with_introns
from annodelta.config import Comparison
from annodelta.operators import difference, matching, pairing, regions
from tests.test_shuffles import _shuffles

FEATURES = "contig string, gene_id string, transcript_id string, type string, start long, end long, fwd boolean, ord int, part long"
TRANSCRIPTS = ("contig string, gene_id string, transcript_id string, transcript_name string, transcript_biotype string, source string, "
               "start long, end long, fwd boolean, part long")


def _release(spark, seed):
    rng, features, transcripts = random.Random(seed), [], []
    for n in range(40):
        contig, fwd, at = rng.choice("12"), rng.random() < 0.5, rng.randint(1, 300)
        rows = []
        for k in range(rng.choice([0, 1, 2, 5])):
            start = at + 40 * k + rng.randint(0, 45)
            rows.append(("exon", start, start + rng.randint(0, 30)))
            if rng.random() < 0.5:
                rows.append((rng.choice(["CDS", "stop_codon", "unknown"]), start, start + 2))
        if n % 9 == 0 and rows:
            rows.append(("intron", at, at + 5))
        features += [(contig, f"G{n}", f"T{n}", kind, a, b, fwd, k, n) for k, (kind, a, b) in enumerate(rows)]
        transcripts.append((contig, f"G{n}", f"T{n}", None, "b" if n % 2 else None, "s", at, at + 200, fwd, n))
    genes = spark.createDataFrame([(t[0], t[1], None, "b", "s", t[6], t[7], t[8]) for t in transcripts], (
        "contig string, gene_id string, gene_name string, gene_biotype string, source string, start long, end long, fwd boolean"))
    return Annotation(genes, spark.createDataFrame(transcripts, TRANSCRIPTS), spark.createDataFrame(features, FEATURES))


def _plain_lists(target, query):
    """Every transcript, also one without features, has a row."""
    parts = []
    for is_query, a in ((False, target), (True, query)):
        lists = a.features.groupBy("contig", "transcript_id").agg(F.collect_list(F.struct("type", "start", "end", "ord", "fwd")).alias("features"))
        parts.append(a.transcripts.select("contig", "transcript_id", PART).join(lists, ["contig", "transcript_id"], "left").select(
            F.lit(is_query).alias("is_query"), "contig", "transcript_id", PART,
            F.coalesce("features", F.expr("cast(array() as array<struct<type:string,start:bigint,end:bigint,ord:int,fwd:boolean>>)")).alias("features")))
    return parts[0].unionByName(parts[1]).repartition(PART)


def _listed(target, query):
    lists = _plain_lists(target, query)
    return tuple(with_introns(Annotation(a.genes, a.transcripts, lists)) for a in (target, query))


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def forms(spark):
    target, query = _release(spark, 5), _release(spark, 5)
    changed = F.when((F.col("ord") == 1) & (F.col("part") % 3 == 0), F.col("end") + 3).otherwise(F.col("end"))
    query = Annotation(query.genes, query.transcripts, query.features.withColumn("end", changed).where("part % 7 != 1 or ord != 0"))
    return tuple(with_introns(a) for a in (target, query)), _listed(target, query)


def test_matching_and_best_models(forms):
    for solve in (matching.match_transcripts, matching.reciprocal_model_hits):
        rows, listed = (solve(t.transcripts, q.transcripts, t.features, q.features) for t, q in forms)
        assert _rows(rows) == _rows(listed) and rows.count() > 10


def test_region_pairs_and_differences(forms):
    config = Comparison()
    found = []
    for t, q in forms:
        matches = matching.match_transcripts(t.transcripts, q.transcripts, t.features, q.features)
        pairs = difference.transcript_pairs(matches, t, q, config)
        found.append((_rows(regions.pair_regions(pairs, t.features, q.features)), _rows(difference.difference_table(pairs, t, q, config))))
    assert found[0] == found[1] and all(len(x) > 40 for x in found[0])


def test_lists_are_not_shuffled_to_meet_their_transcripts(spark, forms):
    (_, _), (target, query) = forms
    members = target.transcripts.select("contig", "transcript_id", PART, F.lit(False).alias("is_query"))
    children = matching._children(target.features)
    assert _shuffles(join_by_transcript(members, children)) == _shuffles(children) + 1
    empty = target.transcripts.join(transcript_extents(target.features, False).where("cs is null"), "transcript_id").count()
    assert empty > 0


def test_an_order_that_comes_twice_is_one_transcript(spark, tmp_path):
    from workload import release

    folder = "/root/testdata/sf0.001"
    for name in ("customer", "orders", "lineitem"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        twice = rows.unionAll(rows.where("o_orderkey % 5 = 0")) if name == "orders" else rows
        twice = twice.unionAll(rows.where("c_custkey % 7 = 0")) if name == "customer" else twice
        twice.write.parquet(str(tmp_path / f"{name}.parquet"))
    listed = release.listed_releases(spark, str(tmp_path))[0].features
    assert listed.count() == listed.select("is_query", "contig", "transcript_id").distinct().count()
    for side, is_query in (("target", False), ("query", True)):
        rows = with_introns(release.release(spark, str(tmp_path), side)).features.groupBy("contig", "transcript_id").agg(
            F.sort_array(F.collect_list(F.struct("type", "start", "end", "fwd"))).alias("f"))
        lists = listed.where((F.col("is_query") == is_query) & (F.size("features") > 0)).select("contig", "transcript_id", F.sort_array(F.transform(
            "features", lambda f: F.struct(f["type"].alias("type"), f["start"].alias("start"), f["end"].alias("end"), f["fwd"].alias("fwd")))).alias("f"))
        assert rows.exceptAll(lists).count() == 0 and lists.exceptAll(rows).count() == 0 and rows.count() > 1000


def test_ranked_regions(spark):
    target, query = _release(spark, 5), _release(spark, 5)
    query = Annotation(query.genes, query.transcripts, query.features.where("part % 4 != 1 or ord != 0"))
    lists = _plain_lists(target, query)
    pairs = []
    for more in ([], [PART]):
        columns = ["contig", "gene_id", "transcript_id", "start", "end", "fwd", *more]
        pairs.append(pairing.pair_by_id(target.transcripts.select(columns), query.transcripts.select(columns), ["contig", "gene_id", "transcript_id"]))
    columns = ["contig", "transcript_id", "gene_id", "type", "rank", "type_in_both", "side_state", *(f"{p}_{c}" for p in "tq" for c in ("start", "end", "fwd"))]
    rows = pairing.old_style_region_pairs(target.features, query.features, pairs[0])
    listed = pairing.old_style_region_pairs(lists, lists, pairs[1])
    assert _rows(rows.select(columns)) == _rows(listed.select(columns)) and rows.where("side_state != 'both'").count() > 5
