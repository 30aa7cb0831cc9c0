"""The corpus pipeline: stages over documents, each calling one operator of the training-data subpackage.

A stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return the columns of
documents. Rows with a null doc_id cannot be told apart by id: near-dedup leaves them as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annodelta.llm import lines, packing, suffixes, toxicity, trie
from annodelta.llm.queries import documents, toxicity_chain
from annodelta.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it is trained on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, toxicity_chain(docs, folder))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the lines of which a near-equal one stands earlier."""
    return lines.without_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every SimHash class: that of smallest id. Rows of one id with different texts are different documents."""
    name = F.xxhash64(F.col("doc_id").cast("long"), F.lit("text"), "text")
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_name", name)
    classes = trie.near_classes(trie.document_prints(named.select(F.col("_name").alias("doc_id"), "text")))
    members = classes.select(F.col("doc_id").alias("_name"), "component_id").distinct().join(
        named.select("_name", F.col("doc_id").alias("_id")).distinct(), "_name")
    kept = members.groupBy("component_id").agg(F.min(F.struct("_id", "_name")).alias("_kept")).select("_kept.*").distinct()
    found = named.join(kept.withColumnRenamed("_name", "_kept"), (F.col("_name") == F.col("_kept")) & (F.col("doc_id") == F.col("_id")))
    first = Window.partitionBy("_kept").orderBy(F.col("text").asc_nulls_first())
    return found.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(docs.columns).unionByName(
        docs.where(F.col("doc_id").isNull()))


def drop_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the bytes that repeat from documents of smaller id."""
    return suffixes.Repeats(docs).applied()


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)


#: The stages train a model and read tokenizers, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": (run, ORACLE_SQL)}
