"""Aggregating exported profiler events per method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta import constants as C


def method_of(frames: Column, packages: list[str]) -> Column:
    """First frame inside one of the packages, else the innermost frame."""
    if not packages:
        return F.get(frames, F.lit(0))
    inside = F.filter(frames, lambda f: F.exists(F.array(*[F.lit(p) for p in packages]), lambda p: f.startswith(p)))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(frames, F.lit(0)))


# The letters of primitive types in method descriptors.
PRIMITIVE_TYPES = {"V": "void", "Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}
_ONE_TYPE = r"\[*(?:L[^;]*;|[^\[])"


def _type_name(code: Column) -> Column:
    """One type of a descriptor as it is written in source text."""
    core = F.ltrim(code, F.lit("["))
    name = F.when(core.startswith("L") & core.endswith(";"), F.translate(core.substr(F.lit(2), F.length(core) - 2), "/", "."))
    for letter, word in PRIMITIVE_TYPES.items():
        name = name.when(core == letter, word)
    return F.concat(name.otherwise(core), F.repeat(F.lit("[]"), F.length(code) - F.length(core)))


def readable_descriptor(descriptor: Column) -> Column:
    """A method descriptor as a list of parameter types and the returned type; other text as it is, nothing as ``()``."""
    whole = F.coalesce(descriptor, F.lit(""))
    close = F.instr(whole, ")")
    params = F.regexp_extract_all(whole.substr(F.lit(2), close - 2), F.lit(_ONE_TYPE), F.lit(0))
    shown = F.concat(F.lit("("), F.array_join(F.transform(params, _type_name), ", "), F.lit(")"),
                     _type_name(whole.substr(close + 1, F.length(whole))))
    return F.when(whole == "", "()").when(~whole.startswith("(") | (close == 0), whole).otherwise(shown)


def one_line(text: Column) -> Column:
    """Text without tabs and line ends, as a cell of a table; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\r\n", "   ")


def method_totals(events: DataFrame) -> DataFrame:
    """Per recording and method: CPU samples, allocations and allocated bytes.

    Input: recording, kind (cpu or alloc), method, bytes.
    """
    return events.groupBy("recording", "method").agg(
        F.count_if(F.col("kind") == "cpu").alias("cpu_samples"),
        F.count_if(F.col("kind") == "alloc").alias("allocations"),
        F.sum(F.when(F.col("kind") == "alloc", F.col("bytes")).otherwise(0)).alias("allocated_bytes"),
    )


def top_methods(totals: DataFrame, by: str, n: int = C.PROFILE_TOP_N) -> DataFrame:
    """The n methods with the largest value of ``by``, the smaller name on ties."""
    return totals.orderBy(F.desc(by), "recording", "method").limit(n)


def recording_summary(events: DataFrame) -> DataFrame:
    """Totals and time span of each recording."""
    return events.groupBy("recording").agg(
        F.count_if(F.col("kind") == "cpu").alias("cpu_samples"),
        F.sum(F.when(F.col("kind") == "alloc", F.col("bytes")).otherwise(0)).alias("allocated_bytes"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span_micros"),
    )


def task_totals(stopwatch: DataFrame) -> DataFrame:
    """Summed milliseconds per task of a stopwatch log (task, millis)."""
    return stopwatch.groupBy("task").agg(F.sum("millis").alias("millis"), F.count(F.lit(1)).alias("runs"))
