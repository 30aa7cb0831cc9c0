import random

import pytest
from pyspark.sql import functions as F

from annodelta.functions.alignment import align
from annodelta.operators import fallback, history, loci
from annodelta.operators.origins import filter_by_origins, found_origins
from annodelta.operators.scan import Extreme, running
from annodelta.operators.signature import transcript_signatures
from annodelta.operators.skew import salted_join
from annodelta.functions import sequence, text

SCHEMA = "contig string, fwd boolean, id string, start long, end long"


def random_intervals(seed, n, prefix, spread, sizes):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        start = rng.randint(1, spread)
        rows.append((rng.choice("ab"), rng.random() < 0.5, f"{prefix}{k}", start, start + rng.choice(sizes)))
    return rows


def overlaps(a, b):
    return a[:2] == b[:2] and a[3] <= b[4] and b[3] <= a[4]


def components(ts, qs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t in ts:
        for q in qs:
            if overlaps(t, q):
                parent[find(("t", t[2]))] = find(("q", q[2]))
    groups = {}
    starts = {("t", r[2]): r[3] for r in ts} | {("q", r[2]): r[3] for r in qs}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(starts[y] for y in members) for members in groups.values() for x in members}


@pytest.mark.parametrize("spread,sizes", [(3000, [0, 5, 40, 300]), (2_000_000, [10, 5000, 300_000]), (60, [0, 1, 2, 3])])
@pytest.mark.parametrize("blocked", [False, True])
def test_loci_are_the_components_of_the_overlap_graph(spark, spread, sizes, blocked):
    ts, qs = random_intervals(spread, 90, "t", spread, sizes), random_intervals(spread + 1, 80, "q", spread, sizes)
    t, q = spark.createDataFrame(ts, SCHEMA), spark.createDataFrame(qs, SCHEMA)
    t_in, q_in = loci.assign_loci(t, q, ["contig", "fwd"], blocked)
    found = {("t", r.id): r.locus for r in t_in.collect()} | {("q", r.id): r.locus for r in q_in.collect()}
    assert found == components(ts, qs)


def test_islands_are_not_components(spark):
    t = spark.createDataFrame([("a", True, "t1", 1, 10), ("a", True, "t2", 5, 20)], SCHEMA)
    q = spark.createDataFrame([("a", True, "q1", 1, 3), ("a", True, "q2", 15, 20)], SCHEMA)
    t_in, q_in = loci.assign_loci(t, q, ["contig", "fwd"])
    assert {r.id: r.locus for r in t_in.unionByName(q_in).collect()} == {"t1": 1, "q1": 1, "t2": 5, "q2": 5}


@pytest.mark.parametrize("sizes", [[0, 3, 50], [100, 200_000, 3_000_000]])
def test_overlap_join_equals_all_pairs(spark, sizes):
    ts, qs = random_intervals(7, 70, "t", 4_000_000, sizes), random_intervals(8, 70, "q", 4_000_000, sizes)
    joined = loci.overlapping_pairs(spark.createDataFrame(ts, SCHEMA), spark.createDataFrame(qs, SCHEMA), ["contig", "fwd"])
    found = sorted((r.t_id, r.q_id) for r in joined.collect())
    assert found == sorted((t[2], q[2]) for t in ts for q in qs if overlaps(t, q))


def test_running_extremes_in_blocks_equal_one_window(spark):
    rng = random.Random(5)
    rows = [("k", p, rng.choice([None, rng.randint(0, 99)])) for p in rng.sample(range(1, 400_000), 300)]
    df = spark.createDataFrame(rows, "key string, pos long, v long")
    wanted = [Extreme(f"e{i}", F.col("v"), b, inc) for i, (b, inc) in enumerate([(1, 1), (1, 0), (0, 1), (0, 0)])]
    one, many = (
        sorted(tuple(r) for r in running(df, ["key"], "pos", wanted, blocked).select("pos", "e0", "e1", "e2", "e3").collect())
        for blocked in (False, True)
    )
    assert one == many


def test_salted_join_meets_every_pair_once(spark):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("cold", 1)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(45)] + [("cold", 2), ("none", 3)], "k string, b int")
    rows = salted_join(left, right, ["k"], rows_per_cell=10).collect()
    assert len(rows) == 60 * 45 + 1 == len({(r.k, r.a, r.b) for r in rows})


def feature_rows(spark, rows):
    return spark.createDataFrame(
        [("1", "g", tx, kind, s, e, fwd, n) for n, (tx, kind, s, e, fwd) in enumerate(rows)],
        "contig string, gene_id string, transcript_id string, type string, start long, end long, fwd boolean, ord int")


def test_signature_follows_the_strand_and_keeps_file_order_on_ties(spark):
    features = feature_rows(spark, [
        ("f", "exon", 10, 19, True), ("f", "CDS", 10, 14, True), ("f", "exon", 1, 3, True),
        ("r", "CDS", 10, 14, False), ("r", "exon", 10, 19, False), ("r", "exon", 1, 3, False),
    ])
    found = {r.transcript_id: r.signature for r in transcript_signatures(features).collect()}
    assert found == {"f": "exon:3;exon:10;CDS:5", "r": "CDS:5;exon:10;exon:3"}
    assert transcript_signatures(features, ["stop_codon"]).count() == 0


def test_long_signatures_in_pieces_keep_equality(spark, monkeypatch):
    from annodelta.operators import signature
    monkeypatch.setattr(signature, "OPS_PER_PIECE", 2)
    rows = [(tx, "exon", at + shift, at + shift + (9 if tx != "c" or at < 60 else 8), True)
            for tx, shift in (("a", 0), ("b", 5000), ("c", 0)) for at in range(1, 80, 15)]
    found = {r.transcript_id: (r.n_ops, r.signature) for r in transcript_signatures(feature_rows(spark, rows)).collect()}
    assert found["a"] == found["b"] and found["a"][0] == found["c"][0] == 6 and found["a"] != found["c"]


def test_single_region_signatures_carry_the_sequence(spark):
    features = feature_rows(spark, [("a", "exon", 1, 4, True), ("b", "exon", 11, 14, True), ("c", "exon", 21, 24, True)])
    texts = spark.createDataFrame([("1", "a", "acgt"), ("1", "b", "ACGT"), ("1", "c", "ACGA")], "contig string, transcript_id string, sequence string")
    found = {r.transcript_id: r.signature for r in transcript_signatures(features, None, texts).collect()}
    assert found["a"] == found["b"] != found["c"]


def test_origin_filter(spark):
    df = spark.createDataFrame(
        [("a", "GENE_ID_MAPPING,STRUCTURE_BASED_MAPPING,DISTANCE:0"), ("b", "STRUCTURE_BASED_MAPPING,DISTANCE:17"),
         ("c", "NEWS,DISTANCE:-1")], "id string, mapping_origins string")
    found = {r.id: set(r.o) for r in df.select("id", found_origins(F.col("mapping_origins")).alias("o")).collect()}
    assert found == {"a": {"GENE_ID_MAPPING", "STRUCTURE_BASED_MAPPING", "OVERLAPPING"},
                     "b": {"STRUCTURE_BASED_MAPPING", "DISTANCE"}, "c": {"DISTANCE"}}
    assert [r.id for r in filter_by_origins(df, ["OVERLAPPING", "GENE_ID_MAPPING"], True).collect()] == ["a"]
    assert [r.id for r in filter_by_origins(df, ["DISTANCE"], False).collect()] == ["b", "c"]


def test_reverse_complements_and_proteins(spark):
    row = spark.createDataFrame([("ACGTacgtnX", "ATGTAAGGG", "ATGTAACCC", "ATGCCC", "ATGCCA")], "s string, a string, b string, c string, d string").select(
        sequence.reverse_complement(F.col("s")).alias("kept"), sequence.reverse_complement_upper(F.col("s")).alias("upper"),
        sequence.translate_codons(F.lit("ATGTTTNNNTAAG")).alias("protein"),
        sequence.protein_changed(F.col("a"), F.col("b")).alias("after_stop"),
        sequence.protein_changed(F.col("a"), F.col("c")).alias("lengths"),
        sequence.protein_changed(F.lit("ATGCCC"), F.lit("ATGACC")).alias("last_skipped"),
        sequence.protein_changed(F.lit("ATGCCC"), F.lit("ATGACC"), False).alias("last_seen"),
    ).collect()[0]
    assert tuple(row) == ("NNacgtACGT", "NNNNNNACGT", "MFX*", False, True, False, True)


def test_attributes_keep_repeated_keys(spark):
    line = 'gene_id "G1"; tag "a b"; tag "c"; level 2; empty "";'
    row = spark.createDataFrame([(line,)], "s string").select(text.parse_attributes(F.col("s")).alias("m"),
                                                              text.attribute_value(F.col("s"), "tag").alias("t"),
                                                              text.attribute_value(F.col("s"), "id").alias("none")).collect()[0]
    assert row.m == {"gene_id": ["G1"], "tag": ["a b", "c"], "level": ["2"], "empty": [""]}
    assert (row.t, row.none) == ("a b", None)


def test_fallback_finds_edited_copies_and_no_strangers(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (150, 900, 4000, 4000)]
    edited = [t[:60] + "T" + t[61:] for t in texts[:3]] + ["".join(rng.choice("ACGT") for _ in range(4000))]
    targets = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(texts)] + [("t9", texts[1])], "id string, sequence string")
    queries = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(edited)] + [("q8", edited[0]), ("q9", texts[1])], "id string, sequence string")
    found = {r.query_id: r.target_id for r in fallback.map_by_alignment(targets, queries).collect()}
    assert found == {"q0": "t0", "q8": "t0", "q1": "t1", "q2": "t2", "q9": "t1"}


def test_fallback_serves_queries_whose_words_are_common(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(3)]
    targets = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(texts)], "id string, sequence string")
    queries = spark.createDataFrame([(f"q{i}", s[:-1]) for i, s in enumerate(texts)], "id string, sequence string")
    found = {r.query_id: r.target_id for r in fallback.map_by_alignment(targets, queries).collect()}
    assert found == {"q0": "t0", "q1": "t1", "q2": "t2"}


def test_fallback_stays_within_the_contig(spark):
    rng = random.Random(11)
    text = "".join(rng.choice("ACGT") for _ in range(500))
    schema = "contig string, id string, sequence string"
    targets = spark.createDataFrame([("1", "1t", text), ("2", "2t", text), ("3", "3t", None)], schema)
    queries = spark.createDataFrame([("2", "2q", text), ("2", "2r", text[:250] + "A" + text[250:]), ("3", "3q", text), (None, "q", text)], schema)
    found = {r.query_id: r.target_id for r in fallback.map_by_alignment(targets, queries, ["contig"]).collect()}
    assert found == {"2q": "2t", "2r": "2t"}


def test_fallback_goes_on_after_a_rejected_candidate(spark):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    text = letters(300)
    around = letters(250) + text + letters(250)  # holds the query whole, but is covered too little
    copy = text[:100] + ("A" if text[100] != "A" else "C") + text[101:]
    targets = spark.createDataFrame([("a", around), ("b", copy)], "id string, sequence string")
    queries = spark.createDataFrame([("q", text)], "id string, sequence string")
    assert [(r.query_id, r.target_id) for r in fallback.map_by_alignment(targets, queries).collect()] == [("q", "b")]


def test_fallback_candidates_lose_no_acceptable_pair(spark):
    """Every pair that the alignment accepts is a candidate, for lengths from 1 up, clipped and edited."""
    rng = random.Random(13)
    texts, edited = [], []
    for n in [*range(1, 60), *range(60, 700, 23)]:
        text = "".join(rng.choice("ACGT") for _ in range(n))
        texts.append(text)
        for share in (0.0, 0.03, 0.05):
            other = list(text)
            for _ in range(int(n * share)):
                at = rng.randrange(len(other))
                other[at:at + 1] = rng.choice(["", "A", "CG", "T"])
            head, tail = rng.randrange(n // 10 + 1), rng.randrange(n // 10 + 1)
            own = "".join(rng.choice("ACGT") for _ in range(head)) + "".join(other)[head:len(other) - tail]
            edited.append(own or "A")
    schema = "id string, sequence string"
    targets = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(texts)], schema)
    queries = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(edited)], schema)
    kept = {tuple(r) for r in fallback.candidates(targets, queries).collect()}
    missed = []
    for i, q in enumerate(edited):
        for j, t in enumerate(texts):
            if not 0.7 * len(q) <= len(t) <= 1.4 * len(q):
                continue
            aligned_q, aligned_t, edits, columns = align(q, t)
            good = columns and aligned_q >= 0.8 * len(q) and aligned_t >= 0.8 * len(t) and edits <= 0.05 * columns
            if good and (f"q{i}", f"t{j}") not in kept:
                missed.append((q, t))
    assert not missed and len(kept) >= len(texts)


def test_id_history(spark):
    rows = [("A", "B", 1.0, 2.0), ("B", "C", 2.0, 3.0), ("B", "D", 2.0, 9.0), ("D", "B", 2.0, 3.0), ("X", "Y", 1.0, 2.0), ("Y", "", 2.0, 3.0)]
    log = spark.createDataFrame(rows, "old_id string, new_id string, old_release float, new_release float")
    assert {tuple(r) for r in history.successors(log, 1.0, 5.0).collect()} == {("A", "B"), ("A", "C")}


def test_id_report_compares_texts_of_equal_length(spark):
    from annodelta.operators import pairing
    from annodelta.operators.genome import chunk_sequences

    genes = spark.createDataFrame([("1", "same", 1, 20, True), ("1", "other", 31, 50, True)], "contig string, gene_id string, start long, end long, fwd boolean")
    shifted = genes.withColumns({c: F.col(c) + 3 for c in ("start", "end")})
    pairs = pairing.pair_by_id(genes, shifted, ["contig", "gene_id"])
    own = "contig string, gene_id string, transcript_id string, start long, end long, fwd boolean"
    tx = spark.createDataFrame([("1", "same", "s", 1, 20, True), ("1", "other", "o", 31, 50, True)], own)
    moved = tx.withColumns({c: F.col(c) + 3 for c in ("start", "end")})
    transcripts = pairing.transcripts_of_gene_pairs(pairs, tx, moved)
    feature = "contig string, transcript_id string, type string, start long, end long, fwd boolean, ord int"
    regions = spark.createDataFrame(
        [("1", "s", "exon", 1, 9, True, 0), ("1", "o", "exon", 31, 39, True, 0), ("1", "o", "CDS", 41, 44, True, 1)], feature)
    later = regions.withColumns({c: F.col(c) + 3 for c in ("start", "end")})
    region_pairs = pairing.old_style_region_pairs(regions, later, transcripts)
    text = "ACGTTGCAAC" * 6
    changed = "GGG" + text[:34] + "N" + text[35:]  # in the first exon of the other gene
    genomes = [chunk_sequences(spark.createDataFrame([("1", t)], "contig string, seq string"), 7) for t in (text, changed)]
    found = {tuple(r) for r in pairing.old_style_differences(pairs, transcripts, region_pairs, *genomes, 7).collect()}
    assert ("same", "", "") in found and not {r for r in found if r[0] == "same"} - {("same", "", "")}
    assert {r for r in found if "seq" in r[2]} == {("other", "gene", "seq"), ("other", "transcript", "seq_o"), ("other", "feature", "seq_o_exon")}
    assert ("other", "", "") not in found


def test_fallback_keeps_only_target_words_that_queries_have(spark, monkeypatch):
    """What is kept between the steps grows with the queries, not with the positions of all targets."""
    rng = random.Random(14)
    texts = ["".join(rng.choice("ACGT") for _ in range(2000)) for _ in range(20)]
    kept = []

    def counted(df):
        kept.append(df.count())
        return df

    monkeypatch.setattr(fallback, "cut_lineage", counted)
    targets = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(texts)], "id string, sequence string")
    queries = spark.createDataFrame([("q", texts[3][:700] + "A" + texts[3][701:])], "id string, sequence string")
    found = [(r.query_id, r.target_id) for r in fallback.candidates(targets, queries).collect()]
    assert found == [("q", "t3")] and max(kept) < 1000


def test_fallback_tells_contigs_apart_and_splits_long_texts(spark, monkeypatch):
    """Words of texts taken at once, of pieces of a text, and of texts beyond the basic plane are found all the same."""
    monkeypatch.setattr(fallback, "LETTERS_AT_ONCE", 500)
    monkeypatch.setattr(fallback, "LETTERS_A_BUCKET", 100)
    rng = random.Random(15)
    texts = ["".join(rng.choice("AC😀é") for _ in range(n)) for n in (90, 300, 499, 501, 1700, 4)]
    schema = "contig int, id string, sequence string"
    targets = spark.createDataFrame([(c, f"t{c}{i}", s) for c in (1, 2) for i, s in enumerate(texts)], schema)
    queries = spark.createDataFrame([(2, f"q{i}", s[:len(s) // 2] + "é" + s[len(s) // 2:]) for i, s in enumerate(texts[:5])], schema)
    found = {tuple(r) for r in fallback.candidates(targets, queries, ["contig"]).collect()}
    assert {(f"q{i}", f"t2{i}") for i in range(5)} <= found and all(t.startswith("t2") for _, t in found)
