from __future__ import annotations

import pytest

#: Texts with the awkward cases: null, empty, blank, ties, repeated rows, long and non-Latin texts.
LINE = "The quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion in the cellar"
PASSAGE = ("a passage of well over fifty words that several documents share, word for word, so that the later ones lose it "
           "and only the first one keeps it: " + " ".join(f"shared{k}" for k in range(60)))


@pytest.fixture(scope="session")
def rows():
    prose = " ".join(f"word{k % 37}x{k % 11}" for k in range(400))
    return [
        (0, prose + "\n" + LINE, "en"), (1, prose + "\n" + LINE, "en"), (2, None, None), (3, "", "en"),
        (4, " \n\t ", "fr"), (5, "one", "xx"), (6, "Alpha beta " + PASSAGE, "en"), (7, PASSAGE + " gamma delta", "de"),
        (8, LINE.replace("bitter", "better") + "\nIt's 's 'tis don't\n\n  x", "en"), (9, "日本語のテキスト、" * 40, "ja"),
        (10, LINE.upper() + " Under the MIT License. under the mit license", "en"),
        (11, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "en"),
        (12, "This work is licensed under the GNU General Public License, version 3.", "en"),
        (13, prose.replace("word3x3", "changed"), "en"), (14, "é" * 3000 + " " + prose, "fr"), (9, "日本語のテキスト、" * 40, "ja"),
        (None, prose, "en"), (40, "a" * 700, None), (41, "ab " * 500, "en"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with columns that clash with internal names."""
    return spark.createDataFrame(
        [(i, t, lang, "s", 0, "x", 1.5) for i, t, lang in rows],
        "doc_id long, text string, lang string, source string, n_chars long, words string, node double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
