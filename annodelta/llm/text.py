"""Column expressions on text shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: ASCII characters that are neither letters nor digits.
ASCII_MARKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else; pure ASCII text takes the fast function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, separators: str, pattern: str) -> Column:
    """Maximal runs of other characters than ``separators`` (``pattern`` says the same as a regular expression)."""
    inner = F.btrim(text, F.lit(separators))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, pattern))


def space_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return split_words(text, ASCII_SPACE, r"[\x20\x09-\x0D]+")


def mark_words(lowered: Column) -> Column:
    """Words of lower-cased text between ASCII characters other than letters and digits."""
    return split_words(lowered, ASCII_MARKS, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def neighbours(words: Column, count: int) -> Column:
    """For each word an entry w0, w1, ...: it and the words after it, null beyond the end."""
    later = [F.slice(words, k + 1, F.size(words)) for k in range(1, count)]
    names = ", ".join(f"w{k}: string" for k in range(count))
    return F.arrays_zip(words, *later).cast(f"array<struct<{names}>>")
