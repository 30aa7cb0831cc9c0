"""How often the rows of regions are shuffled, and that what saves a shuffle changes no result."""

from pyspark.sql import functions as F

from annodelta.functions import sequence
from annodelta.operators import loci, matching, pairing, signature, skew
from workload import release

SMALL = "/root/testdata/sf0.001"
COLUMNS = "contig string, gene_id string, transcript_id string, type string, start long, end long, fwd boolean, ord long"


def _features(spark, shift=0):
    rows = [("c", f"G{t % 5}", f"T{t}", kind, 100 * t + 10 * k + shift, 100 * t + 10 * k + 5 + t % 3, True, k)
            for t in range(40) for k in range(4) for kind in ("exon", "CDS")]
    return spark.createDataFrame(rows, COLUMNS)


def _dealt(features):
    """The rows dealt over the tasks by ``part``, which follows from the transcript id."""
    return features.withColumn("part", F.substring("transcript_id", 2, 9).cast("long")).repartition(4, "part")


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_signatures_of_dealt_rows_need_no_shuffle(spark):
    features = _features(spark)
    dealt = signature.transcript_signatures(_dealt(features))
    assert _shuffles(dealt) == 1  # the dealing itself
    plain = signature.transcript_signatures(features)
    assert dealt.columns == plain.columns
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_rank_pairs_share_one_shuffle_a_side(spark):
    t, q = _features(spark), _features(spark, 3).where("ord < 3 or type = 'CDS'")
    dealt = pairing.pair_by_rank(_dealt(t), _dealt(q))
    assert _shuffles(dealt) <= 3  # the two dealings, and that of both sides together
    rows = pairing.pair_by_rank(t, q)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    assert rows.groupBy("side_state").count().sort("side_state").collect() == [("both", 280), ("missing_in_query", 40)]


def test_regions_of_no_known_type_do_not_pair(spark):
    one = _features(spark).where("transcript_id = 'T1' and ord = 0 and type = 'CDS'").withColumn("type", F.lit(None).cast("string"))
    assert sorted(r.side_state for r in pairing.pair_by_rank(one, one).collect()) == ["missing_in_query", "missing_in_target"]


def test_hot_keys_of_unlike_types_lose_no_pair(spark):
    left = spark.range(300).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    for one, other in ((left, right), (right.withColumnRenamed("b", "a"), right)):
        joined = skew.salted_join(one, other, ["k"], rows_per_cell=20, pairs_per_cell=500)
        assert joined.select("a", "b").distinct().count() == joined.count() == 30_000


def test_mapping_lists_shuffle_lines_once_and_sort_no_region(spark):
    lists = release.feature_lists(spark, SMALL)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan


def test_digests_of_lists_tell_the_same_transcripts_apart(spark):
    for types in (None, ["CDS", "stop_codon"]):
        sides = signature.digests_of_lists(release.feature_lists(spark, SMALL), types)
        of_rows = [signature.signature_digests(a.features, types).withColumnRenamed("signature", "row") for a in release.releases(spark, SMALL)]
        keys = ["contig", "gene_id", "transcript_id"]
        joined = [one.join(other, keys, "full_outer").select("signature", "row") for one, other in zip(sides, of_rows)]
        classes = [tuple(map(bytes, r)) for r in joined[0].union(joined[1]).collect()]
        assert len({a for a, _ in classes}) == len({b for _, b in classes}) == len(set(classes)) > 100


def test_extents_of_signed_transcripts_are_those_of_the_release(spark):
    sides = signature.digests_of_lists(release.feature_lists(spark, SMALL))
    for side, signed in zip(release.SIDES, sides):
        genes = release.with_extents(spark, SMALL, side, signed).genes
        plain = release.release(spark, SMALL, side).genes
        assert genes.columns == plain.columns
        assert sorted(map(str, genes.collect())) == sorted(map(str, plain.collect()))


def test_overlaps_read_their_inputs_once(spark):
    one = F.udf(lambda k: read.add(1) or k, "long").asNondeterministic()
    read = spark.sparkContext.accumulator(0)
    made = spark.range(100).withColumn("start", one("id")).select(
        F.lit("c").alias("contig"), (F.col("start") * 10).alias("start"), (F.col("start") * 10 + 14).alias("end"))
    pairs = loci.overlapping_pairs(made, made.withColumn("name", F.lit("q")), ["contig"])
    assert pairs.count() == 100 + 2 * 99
    assert read.value == 200


def test_reciprocal_hits_make_their_pairs_once(spark):
    rows = [("c", f"t{t}", f"q{q}", round(1 / (1 + abs(t - q) % 3), 6), t) for t in range(9) for q in range(9)]
    rows += [("c", None, "q1", 9.0, 0), (None, "t1", "q1", 9.0, 0), ("c", "t0", "q0", 0.5, 7)]
    made = F.udf(lambda s: read.add(1) or s, "double").asNondeterministic()
    read = spark.sparkContext.accumulator(0)
    scores = spark.createDataFrame(rows, "contig string, target_transcript_id string, query_transcript_id string, score double, n int")
    found = matching.reciprocal_best_hits(scores.withColumn("score", made("score")))
    assert found.columns == scores.columns
    per = {}
    for own, other in ((1, 2), (2, 1)):
        for r in rows:
            key = (own, r[0], r[own])
            if key not in per or (-r[3], r[other] or "") < (-per[key][3], per[key][other] or ""):
                per[key] = r
    mutual = [r for (own, c, i), r in per.items() if own == 1 and None not in (c, *r[1:3]) and per[(2, c, r[2])][1] == i]
    assert sorted(map(tuple, found.collect())) == sorted(mutual) != []
    assert read.value == len(rows)


def test_verdicts_equal_comparing_the_whole_proteins(spark):
    letters = [("ATGTAAC", "ATGTAGC"), ("TAAATG", "TAGCTG"), ("ATGCCC", "ATGACC"), ("ATGCC", "ATGCCC"), ("NNNXY ", "NNNXYA"),
               ("TTTTAATTT", "TTCTAGCTT"), (None, "ATG"), ("ATG", None), ("", ""), ("AA", "AC"), ("TAACCC", "TAAACC"), ("GGGTAA", "GGATAA")]
    frame = spark.createDataFrame(letters, "a string, b string")
    got = frame.select("a", "b", *(sequence.protein_changed(F.col("a"), F.col("b"), skip) for skip in (True, False)),
                       sequence.translate_codons(F.col("a")), sequence.translate_codons(F.col("b"))).collect()
    for a, b, skipping, whole, x, y in got:
        if a is None or b is None:
            assert skipping is None and whole is None
            continue
        for skip, changed in ((1, skipping), (0, whole)):
            used = (len(a) - skip) // 3 if a else 0
            stop = next((k for k in range(used) if x[k:k + 1] == y[k:k + 1] == "*"), used)
            assert changed == (len(a) != len(b) or x[:stop] != y[:stop]), (a, b, skip)
