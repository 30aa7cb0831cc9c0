"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta.llm import (
    alignment,
    bpe,
    chat,
    counting,
    fertility,
    fingerprints,
    licenses,
    lines,
    packing,
    search,
    suffixes,
    toxicity,
    trie,
)
from annodelta.llm.votes import hex16

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.Repeats(documents(spark, folder)).summary()


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents; ``n_within``: other fingerprints within 3 bits, for the ids divisible by 20."""
    rows = fingerprints.edited_fingerprints(documents(spark, folder))
    found = fingerprints.within_radius(rows, rows.where("doc_id % 20 = 0")).groupBy(
        F.col("query").alias("fingerprint")).agg(F.count("*").alias("n_within"))
    counted = F.when(F.col("doc_id") % 20 == 0, F.coalesce("n_within", F.lit(0).cast("long")))
    return rows.join(found, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fingerprint")).alias("fingerprint"),
        hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", counted.alias("n_within"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    classes = trie.near_classes(trie.document_prints(documents(spark, folder)))
    return classes.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its lines with a word, how many of them go, and the class of the first (in order of names) that goes."""
    docs = documents(spark, folder)
    dropped = lines.dropped_lines(lines.line_classes(docs))
    counted = lines.document_lines(docs).groupBy("doc_id").agg(F.count("*").alias("_lines"))
    joined = docs.select("doc_id").join(counted, "doc_id", "left").join(dropped, F.col("doc_id") == F.col("_doc"), "left")
    return joined.select(
        "doc_id", F.coalesce("_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.array_sort("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"),
        F.col("first_class").alias("class_id"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(documents(spark, folder), path))


def toxicity_chain(docs: DataFrame, folder: str) -> toxicity.Chain:
    """Poor quality first, then toxic."""
    labels = docs.sparkSession.read.parquet(f"{folder}/labels.parquet")
    return toxicity.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity_chain(docs, folder))


def op9_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as chosen side, against the same one with another ending."""
    sides = chat.conversations(spark.read.parquet(f"{folder}/conversations.parquet"), "conv_id")
    rows = chat.format_preferences(sides, chat.other_endings(sides, "conv_id"), "conv_id")
    spelled = [F.array_join(F.transform(f"{side}_spans", lambda s: F.concat_ws("+", s["start"], s["length"])), ",")
               .alias(f"{side}_spans") for side in ("chosen", "rejected")]
    return rows.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *spelled)


OP9_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, text FROM t WHERE k = n),
follow AS (
  SELECT conv_id, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS ending
  FROM ends),
both_sides AS (
  SELECT t.*, CASE WHEN k = n THEN ending ELSE text END AS other FROM t JOIN follow USING (conv_id)),
common AS (
  SELECT conv_id, coalesce(min(k) FILTER (WHERE text <> other) - 1, max(n)) AS c FROM both_sides GROUP BY conv_id),
parts AS (
  SELECT conv_id, k, c, role,
         '<|im_start|>' || role || chr(10) AS header, text || '<|im_end|>' || chr(10) AS yes,
         other || '<|im_end|>' || chr(10) AS no
  FROM both_sides JOIN common USING (conv_id)),
placed AS (
  SELECT *, sum(CASE WHEN k > c THEN length(header) + length(yes) ELSE 0 END) OVER w - length(yes) AS yes_at,
         sum(CASE WHEN k > c THEN length(header) + length(no) ELSE 0 END) OVER w - length(no) AS no_at
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id, CAST(max(c) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(header || yes, '' ORDER BY k) FILTER (WHERE k <= c), '') AS prompt,
       coalesce(string_agg(header || yes, '' ORDER BY k) FILTER (WHERE k > c), '') AS chosen,
       coalesce(string_agg(header || no, '' ORDER BY k) FILTER (WHERE k > c), '') AS rejected,
       coalesce(string_agg(CAST(yes_at AS BIGINT) || '+' || length(yes), ',' ORDER BY k)
                FILTER (WHERE k > c AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(no_at AS BIGINT) || '+' || length(no), ',' ORDER BY k)
                FILTER (WHERE k > c AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
sized AS (SELECT d, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
freq AS (
  SELECT d, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT d, doc_id, n, unnest(w) AS term FROM sized) GROUP BY d, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt
  FROM freq, total GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, d, any_value(doc_id) AS doc_id,
         CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN freq USING (term) JOIN weight USING (term), total GROUP BY item_id, d)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.token_counts(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(documents(spark, folder), *paths)


#: name: (query, SQL for the same rows or None)
QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_suffix_array_dedup": (op1_suffix_array_dedup, None),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_simhash_near_dedup": (op5_simhash_near_dedup, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_best_fit_packing": (op7_best_fit_packing, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_preference_format": (op9_preference_format, OP9_SQL),
    "op10_license_scan": (op10_license_scan, None),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_token_counts": (op12_token_counts, None),
    "op13_tokenizer_alignment": (op13_tokenizer_alignment, None),
}
