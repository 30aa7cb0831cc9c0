from __future__ import annotations

import random

import pytest

from annodelta.operators import similarity
from annodelta.operators.signature import transcript_signatures

FEATURE = "contig string, gene_id string, transcript_id string, type string, start long, end long, fwd boolean, ord int"


def features(spark, seed, prefix, n):
    """Transcripts from a few templates with changed lengths, types, and regions left out; on both strands."""
    rng = random.Random(seed)
    templates = [[(rng.choice(["exon", "CDS"]), rng.randint(20, 900)) for _ in range(rng.choice([1, 1, 2, 5, 12, 25]))] for _ in range(6)]
    lists, rows = {}, []
    for k in range(n):
        regions = [(t if rng.random() > 0.05 else "intron", max(1, round(size * rng.uniform(0.8, 1.0)))) if rng.random() < 0.3 else (t, size)
                   for t, size in rng.choice(templates) if rng.random() > 0.03] or [("exon", 5)]
        name, contig, fwd, at = f"{prefix}{k}", rng.choice("12"), rng.random() < 0.5, 1
        lists[name] = contig, regions
        for ord_, (kind, size) in enumerate(regions if fwd else regions[::-1]):
            rows.append((contig, f"g{k % 7}", name, kind, at, at + size - 1, fwd, ord_))
            at += size + 10
    return spark.createDataFrame(rows, FEATURE), lists


def compare(a, b):
    total = sum(min(x[1], y[1]) / max(x[1], y[1]) for x, y in zip(a, b) if x[0] == y[0])
    return total / max(len(a), len(b))


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.9, 1.0])
def test_against_all_pairs(spark, cutoff):
    (t, t_lists), (q, q_lists) = features(spark, 4, "t", 60), features(spark, 4, "q", 70)
    t_sig, q_sig = transcript_signatures(t), transcript_signatures(q)
    near = similarity.similar_signatures(t_sig, q_sig, t, q, cutoff)
    found = {(r.contig, r.t, r.q) for r in t_sig.withColumnsRenamed({"signature": "t_signature", "transcript_id": "t"}).join(
        near, ["contig", "t_signature"]).join(q_sig.withColumnsRenamed({"signature": "q_signature", "transcript_id": "q"}).drop("gene_id"),
                                              ["contig", "q_signature"]).collect()}
    expected = {(c, a, b) for a, (c, x) in t_lists.items() for b, (d, y) in q_lists.items() if c == d and compare(x, y) >= cutoff - 1e-9}
    assert found == expected and len(expected) > 20
    named = similarity.as_query_signatures(t_sig, near).join(q_sig.select("contig", "signature"), ["contig", "signature"], "left_semi")
    assert {r.transcript_id for r in named.collect()} == {a for _, a, _ in expected}


def test_single_regions_by_sequence(spark):
    rows = [("1", "g", "a", "exon", 1, 100, True, 0), ("1", "g", "b", "exon", 1, 95, True, 0)]
    frame = spark.createDataFrame(rows, FEATURE)
    texts = spark.createDataFrame([("1", "a", "ACGT"), ("1", "b", "ACGT")], "contig string, transcript_id string, sequence string")
    sig = transcript_signatures(frame, sequences=texts)
    assert similarity.similar_signatures(sig, sig, frame, frame, 0.9, single_by_sequence=True).count() == 2
    assert similarity.similar_signatures(sig, sig, frame, frame, 0.9).count() == 4
    with pytest.raises(ValueError):
        similarity.similar_signatures(sig, sig, frame, frame, 0.5)


def test_readable_descriptors(spark):
    from pyspark.sql import functions as F

    from annodelta.operators import profile

    cases = {"(ILjava/lang/String;[[D)V": "(int, java.lang.String, double[][])void", "()J": "()long", "": "()", None: "()",
             "plain": "plain", "(broken": "(broken", "([La/B;Z)[Lc/D$E;": "(a.B[], boolean)c.D$E[]"}
    frame = spark.createDataFrame([(c,) for c in cases], "d string")
    assert {r[0]: r[1] for r in frame.select("d", profile.readable_descriptor(F.col("d"))).collect()} == cases
    assert spark.range(1).select(profile.one_line(F.lit("a\tb\r\nc"))).first()[0] == "a b  c"


def test_codes_rule_out_no_pair_at_the_cutoff(spark):
    """Of all pairs of lists, those as similar as the cutoff pass the bound of the codes, and most others do not."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    base = [[(rng.choice(["exon", "CDS", "utr"]), rng.randint(1, 3000)) for _ in range(rng.choice([1, 3, 7, 8, 12]))] for _ in range(30)]
    near = [[(t, max(1, round(n * rng.uniform(0.75, 1.0)))) for t, n in x][:rng.randint(1, 12)] for x in base for _ in range(2)]
    frame = spark.createDataFrame(list(enumerate(base + near)), "id long, regions array<struct<type:string,length:long>>")
    t, q = (frame.select(F.col("id").alias(s), F.col("regions").alias(f"{s}_regions"), *similarity._place_codes(F.col("regions"), s),
                         F.size("regions").alias(size)) for s, size in (("t", "m"), ("q", "n")))
    for cutoff in (0.6, 0.9):
        pairs = t.crossJoin(q).select(
            similarity.structure_similarity(F.col("t_regions"), F.col("q_regions")).alias("s"), similarity._may_reach(cutoff).alias("passed")).collect()
        assert all(r.passed for r in pairs if r.s >= cutoff)
        assert cutoff < 0.9 or sum(r.passed for r in pairs) < len(pairs) // 4


def test_lists_that_have_no_codes_pass(spark):
    from pyspark.sql import functions as F

    rows = [(1, [("exon", 0)]), (2, [("exon", None)]), (3, [(None, 5)]), (4, [])]
    frame = spark.createDataFrame(rows, "id long, regions array<struct<type:string,length:long>>")
    coded = frame.select("id", *similarity._place_codes(F.col("regions"), "t")).orderBy("id").collect()
    assert [r.t_code_a for r in coded] == [None, None, None, 0]
