"""Preference formatting of chosen and rejected conversations.

DataFrame functions only. The turns of either side are gathered in order, the longest common prefix of turns is rendered
once as prompt, and what is left of each side becomes a completion with the spans a loss may see: the text and end mark
of assistant turns. Everything else is masked.

Defined cases: null roles are ``unknown``, null texts empty; turns of equal number are ordered by role and text; a null
turn comes first; pairs that lack a side are left out; if one side is a prefix of the other its completion is empty, and
of equal sides both are; null pair ids are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.order import with_next

#: Fixed values of the chat template.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """key and ``turns``, an array of (turn, role, text) in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans (arrays of start and length).

    Both sides: ``key`` and ``turns`` as :func:`conversations` gives them. Spans count characters of their completion.
    """
    both = chosen.select(key, F.col("turns").alias("_c")).join(
        rejected.select(F.col(key).alias("_key"), F.col("turns").alias("_r")), F.col(key) == F.col("_key"))
    equal = F.transform(
        F.arrays_zip(F.col("_c"), F.col("_r")),
        lambda z: F.coalesce((z["_c"]["role"] == z["_r"]["role"]) & (z["_c"]["text"] == z["_r"]["text"]), F.lit(False)))
    first_difference = F.array_position(equal, False)
    common = F.when(first_difference > 0, first_difference - 1).otherwise(F.size("_c")).cast("int")
    split = both.withColumn("_n", common)
    rest = {name: F.slice(F.col(side), F.col("_n") + 1, F.greatest(F.size(side) - F.col("_n"), F.lit(0)))
            for name, side in (("chosen", "_c"), ("rejected", "_r"))}
    return split.select(
        key, F.col("_n").cast("long").alias("n_prompt_turns"), _rendered(F.slice("_c", 1, F.col("_n"))).alias("prompt"),
        *(_rendered(turns).alias(name) for name, turns in rest.items()),
        *(_spans(turns).alias(f"{name}_spans") for name, turns in rest.items()))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begun = state["at"] + F.char_length(_header(turn))
        size = F.char_length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(begun.alias("start"), size.alias("length")))
        return F.struct((begun + size).alias("at"),
                        F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
                        .alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def other_endings(sides: DataFrame, key: str) -> DataFrame:
    """Rejected sides for conversations without any: the last turn says what the next conversation's last turn says."""
    last = F.element_at("turns", -1)
    follow = with_next(sides.select(key, last["text"].alias("_last")), key, [key, "_last"]).select(
        F.col(key).alias("_key"), F.col("_next._last").alias("_ending"))
    changed = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("_ending").alias("text"))
    return sides.join(follow, F.col(key) == F.col("_key")).select(
        key, F.concat(F.slice("turns", 1, F.size("turns") - 1), F.array(changed)).alias("turns"))
