"""Parsing expressions for attribute columns and alignment lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta import constants as C

# Fixed values: `key "value";` or `key value;` attribute items, CIGAR items.
ATTRIBUTE_PATTERN = r'([A-Za-z0-9_.\-]+)\s+(?:"([^"]*)"|([^";\s]+))'
CIGAR_PATTERN = r"([0-9]+)([MIDNSHP=X])"


def parse_attributes(text: Column) -> Column:
    """``map<string, array<string>>`` of an attribute column; repeated keys keep all values in order."""
    keys = F.regexp_extract_all(text, F.lit(ATTRIBUTE_PATTERN), F.lit(1))
    quoted = F.regexp_extract_all(text, F.lit(ATTRIBUTE_PATTERN), F.lit(2))
    bare = F.regexp_extract_all(text, F.lit(ATTRIBUTE_PATTERN), F.lit(3))
    items = F.zip_with(
        F.arrays_zip(keys.alias("k"), quoted.alias("a")), bare,
        lambda x, b: F.struct(x["k"].alias("k"), F.when(F.length(b) > 0, b).otherwise(x["a"]).alias("v")),
    )
    return F.map_from_entries(
        F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(k, F.transform(F.filter(items, lambda i: i["k"] == k), lambda i: i["v"])),
        )
    )


def first_attribute(attributes: Column, key: str) -> Column:
    """First value of an attribute, null where absent."""
    return F.get(F.try_element_at(attributes, F.lit(key)), F.lit(0))


def attribute_value(text: Column, key: str) -> Column:
    """First value of one attribute straight from the text, without building the map."""
    pattern = rf'(?:^|[;\s]){key}\s+(?:"([^"]*)"|([^";\s]+))'
    quoted, bare = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), F.when(F.length(bare) > 0, bare).otherwise(quoted))


def first_values(text: Column) -> Column:
    """Attribute text with the first value of every key, keys by first appearance."""
    entries = F.map_entries(parse_attributes(text))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(' "'), F.get(e["value"], F.lit(0)), F.lit('"'))), ";")


def cigar_total(cigar: Column, letters: str) -> Column:
    """Summed length of the operations named in ``letters``."""
    lengths = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{letters}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alignment lines to columns; header lines and lines with fewer than 11 fields are dropped."""
    field = F.split(column, "\t")
    tag = F.regexp_extract(column, r"^(?:[^\t]*\t){11}(?:.*?\t)?NM:i:([0-9]+)", 1)  # among the optional fields
    return (
        lines.where(~F.col(column).startswith("@") & (F.size(field) >= 11))
        .select(
            field[0].alias("qname"), field[1].cast("int").alias("flag"), field[2].alias("rname"),
            field[4].cast("int").alias("mapq"), field[5].alias("cigar"), F.length(field[9]).alias("query_length"),
            F.coalesce(F.when(F.length(tag) > 0, tag.cast("long")), F.lit(0).cast("long")).alias("mismatches"),
        )
    )


def accept_alignments(alignments: DataFrame, reference_lengths: DataFrame) -> DataFrame:
    """Primary, mapped alignments covering and matching both sequences well enough.

    ``reference_lengths`` has rname, reference_length. Adds cover_query, cover_reference, identity.
    """
    m, i, d = (cigar_total(F.col("cigar"), x) for x in ("M=X", "I", "D"))
    measured = (
        alignments.where((F.col("flag").bitwiseAND(C.SAM_NOT_PRIMARY) == 0) & (F.col("rname") != "*"))
        .join(reference_lengths, "rname")
        .withColumns({"m": m, "i": i, "d": d})
        .withColumns({
            "cover_query": F.when(F.col("query_length") > 0, (F.col("m") + F.col("i")) * 100.0 / F.col("query_length")).otherwise(0.0),
            "cover_reference": F.when(F.col("reference_length") > 0, (F.col("m") + F.col("d")) * 100.0 / F.col("reference_length")).otherwise(0.0),
            "identity": F.when(
                F.col("m") + F.col("i") + F.col("d") > 0,
                100.0 * (1.0 - F.col("mismatches") / (F.col("m") + F.col("i") + F.col("d"))),
            ).otherwise(0.0),
        })
    )
    return measured.where(
        (F.col("cover_query") >= C.MIN_ALIGNMENT_COVERAGE)
        & (F.col("cover_reference") >= C.MIN_ALIGNMENT_COVERAGE)
        & (F.col("identity") >= C.MIN_ALIGNMENT_IDENTITY)
    ).drop("m", "i", "d")
