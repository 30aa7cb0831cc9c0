from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annodelta.llm import counting

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Special strings, case and composition that depend on place, unassigned code points, contractions, very long runs.
AWKWARD = [
    "", " ", "a", "It's WE'LL they'RE 12345 3.14", "ΟΔΟΣ Σ ΣΣ ας", "İstanbul ẞ ŉ", "é Å 각 ﬁ",
    "x<|startoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|start", "͸a͸ b\U0001fae9c ꟋD",
    "日本語のテキスト", "👩‍👩‍👧 🇩🇪 ok", "\x00\x1c\x85 a　b​c", "a" * 3000, "ab" * 2000 + "!" * 1000, "·" * 700, "\n" * 50_000 + "z",
    "é<|endoftext|>́e",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_as_the_library(spark, docs, rows, library):
    more = spark.createDataFrame([(100 + k, t, "x", "s", 0, "w", 0.0) for k, t in enumerate(AWKWARD)], docs.schema)
    found = counting.token_counts(docs.union(more), PATH, limit=300).collect()
    texts = [(i, t) for i, t, _ in rows] + [(100 + k, t) for k, t in enumerate(AWKWARD)]
    expected = []
    for i, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 300))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_empty_table(spark, empty):
    assert counting.token_counts(empty, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "the ", "'s", "Σ", "́"]))))
def test_random_texts(parts):
    text = "".join(parts)
    assert counting.counter(PATH).count(text) == len(counting.counter(PATH).tool.encode(text, add_special_tokens=False).ids)


def test_forgetting_words(monkeypatch, library):
    monkeypatch.setattr(counting, "CACHE_WORDS", 3)
    own = counting.WordCounter(PATH)
    for text in ["one two three four five", "five six seven", "x" * 100 + " one two", "one"] * 2:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_very_long_word(library):
    text = "ab" * 100_000
    assert counting.counter(PATH).count(text) == len(library.encode(text, add_special_tokens=False).ids)
