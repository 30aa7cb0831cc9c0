from __future__ import annotations

import corpus_pipeline
from annodelta.llm import suffixes
from annodelta.session import cut_lineage


def test_stages_work_on_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, folder)
        assert kept.columns == docs.columns, name
        kept = cut_lineage(kept)
        assert 0 < kept.count() <= rows.count()
        rows = kept
    assert suffixes.Repeats(rows).summary().where("n_removed > 0").count() == 0
    left = {r.doc_id for r in rows.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == left


def test_stages_on_awkward_rows(spark, docs, empty):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0, name
        assert stage(spark, empty, folder).count() == 0, name


def test_near_copies_with_one_id_and_different_texts(spark):
    clean = " ".join(f"clean{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    docs = spark.createDataFrame([(1, clean), (7, clean), (7, other), (7, other), (9, other), (None, other)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    key = lambda row: (row[0] is None, row)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == [(1, clean), (7, other), (None, other)]
