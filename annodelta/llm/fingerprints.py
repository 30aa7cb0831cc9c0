"""Document fingerprints: SimHash over weighted word terms, and search within a Hamming radius by permuted block tables.

DataFrame functions only. A term starts at every word and takes up to three words; function words are short, so a term
weighs 1 plus 1 for each of its words of over three letters. Each term's hash votes with its weight on the 64 signed bits.

Defined cases: null text is empty and has fingerprint zero; equal texts have equal fingerprints; repeated rows are kept
as rows; rows with a null id come last in the order; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.order import with_next
from annodelta.llm.text import neighbours, space_words, whole_text
from annodelta.llm.votes import likeness, sign_bits
from annodelta.session import cut_lineage

TERM_WORDS = 3
LONG_WORD = 3


def fingerprint_texts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys + ``fingerprint``, one row per distinct ``keys``, which must tell the rows of ``texts`` apart."""
    words = space_words(F.lower(F.col(text)))
    exploded = texts.select(*keys, F.posexplode_outer(neighbours(words, TERM_WORDS)).alias("_at", "_term"))
    parts = [F.col(f"_term.w{k}") for k in range(TERM_WORDS)]
    weight = F.lit(1) + sum((F.when(F.char_length(w) > LONG_WORD, 1).otherwise(0) for w in parts), F.lit(0))
    hashed = F.when(F.col("_term").isNotNull(), F.xxhash64(*parts))
    return sign_bits(exploded.select(*keys, F.coalesce("_at", F.lit(0)).alias("_at"), hashed.alias("_hash"),
                                     weight.alias("_weight")),
                     keys, "_at", "_hash", "_weight", TERM_WORDS + 1)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint and that of an edited text, whose second half is the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (longs), near_edited, near_next.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = with_next(texts, "doc_id", ["doc_id", "text"])
    size = F.char_length("text")
    half = F.expr("char_length(text) div 2")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half),
                      F.substring(F.col("_next.text"), F.lit(1), half))
    both = ordered.select(
        "_block", "_rank", "doc_id", size.cast("long").alias("n_chars"), F.xxhash64("text").alias("_text"),
        F.col("_next.doc_id").alias("_next_id"), F.xxhash64("_next.text").alias("_next_text"), "text",
        edited.alias("_edited"),
    ).select("*", F.unhex(F.sha2(F.col("_edited"), 256)).alias("_sha")).select(
        "_block", "_rank", "doc_id", "n_chars", "_text", "_next_id", "_next_text", "_sha",
        F.posexplode(F.array("text", "_edited")).alias("_kind", "_body"))
    keys = ["_block", "_rank", "doc_id", "n_chars", "_text", "_next_id", "_next_text", "_sha", "_kind"]
    prints = fingerprint_texts(both, keys, "_body")
    rows = cut_lineage(prints.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("_kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("_kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint")))
    following = rows.groupBy(F.col("doc_id").alias("_next_id"), F.col("_text").alias("_next_text")).agg(
        F.max("fingerprint").alias("_following"))
    same = (rows["_next_id"].eqNullSafe(following["_next_id"])) & (rows["_next_text"] == following["_next_text"])
    return rows.join(following, same).select(
        "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"))


def _block_bits(blocks: int) -> list[int]:
    """A mask for each of ``blocks`` runs of bits that together make 64."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def tables(radius: int, blocks: int) -> list[int]:
    """Masks of the tables: fingerprints within ``radius`` bits agree on all blocks but ``radius`` of them."""
    parts = _block_bits(blocks)
    return [_signed(sum(kept)) for kept in combinations(parts, blocks - radius)]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, found, distance) for all of ``prints`` within ``radius`` bits of a fingerprint of ``queries``, itself left out.

    Both hold a long ``fingerprint``. Each table keeps the bits of some blocks as key, so any match meets in one of them;
    a match is reported by the first table in which it meets. Equal fingerprints are searched once. Nothing is capped.
    """
    masks = tables(radius, blocks)
    key: Column = F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks)))
    left = queries.select("fingerprint").distinct().select(F.col("fingerprint").alias("query"), key.alias("_table", "_key"))
    right = prints.select("fingerprint").distinct().select(F.col("fingerprint").alias("found"), key.alias("_table2", "_key2"))
    differing = F.col("query").bitwiseXOR(F.col("found"))
    earlier = F.array(*(differing.bitwiseAND(F.lit(m)) == 0 for m in masks))
    on = ((F.col("_table") == F.col("_table2")) & (F.col("_key") == F.col("_key2")) & (F.col("query") != F.col("found"))
          & (F.bit_count(differing) <= radius) & (F.array_position(earlier, True) == F.col("_table") + 1))
    return left.join(right, on).select("query", "found", F.bit_count(differing).alias("distance"))
