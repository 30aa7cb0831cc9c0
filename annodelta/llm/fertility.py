"""Quality rules on tokeniser fertility, with rejection bands per language and script.

Public vocabularies encode every distinct word of a batch once: one with byte fallback, and a byte-level one for many
languages. For each document this gives characters per token of either, the share of byte-fallback tokens and the entropy
of its token distribution; a document is rejected when one of them leaves the band of its language (or, for a language
without bands, of its main script). A text of which fewer than half are letters has a band of its own, which only
long known tokens reach: figures, runs of marks and private characters do not.
Simple base counts come along. Each row is judged by itself, so there is nothing to shuffle.

Defined cases: null or empty text has no words and fails the base rules; null or unknown languages take the bands of
the script; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annodelta.llm.bpe import text_groups
from annodelta.llm.text import whole_text

SYMBOLS = "#*$%&|<>"
WINDOW = 8
CACHE_WORDS = 250_000
LONG_WORD = 1000
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Limits of a language or script. Entropy is compared with the most that the number of tokens allows."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    least_chars_multi: float


#: Bands by language code. They are wide: fluent text of a language lies well inside.
LANGUAGES = {
    "en": Band(1.3, 7.0, 0.10, 0.35, 1.3), "fr": Band(1.2, 7.0, 0.15, 0.35, 1.2),
    "de": Band(1.2, 7.0, 0.15, 0.35, 1.2), "es": Band(1.2, 7.0, 0.15, 0.35, 1.2),
}
#: Bands by script, for other languages. "other": letters that the vocabularies know one by one or as bytes only.
SCRIPTS = {
    "latin": Band(1.0, 7.0, 0.30, 0.35, 1.0), "cyrillic": Band(0.9, 6.0, 0.30, 0.35, 0.5),
    "greek": Band(0.5, 6.0, 0.60, 0.30, 0.4), "cjk": Band(0.30, 4.0, 0.90, 0.30, 0.3),
    "arabic": Band(0.5, 4.0, 0.50, 0.30, 0.4), "hebrew": Band(0.5, 4.0, 0.50, 0.30, 0.4),
    "other": Band(0.25, 5.0, 1.0, 0.30, 0.25), "unlettered": Band(1.5, 6.0, 0.10, 0.35, 1.5),
}
#: Code point ranges of the scripts.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
}
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, chars_per_token double, chars_per_token_multi double, byte_share double, token_entropy double, script string, kept boolean")


class Fertility:
    """The tokens of words, each distinct word encoded once while it stays in the cache."""

    def __init__(self, path: str, multi: str) -> None:
        import sentencepiece

        self.multi = rank_encoding(multi)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.cached: dict[bytes, tuple[np.ndarray, int]] = {}

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the words laid end to end, how many each has, and how many it has in the other vocabulary."""
        missing = [w for w in words if w not in self.cached]
        if missing:
            if len(self.cached) > CACHE_WORDS:
                self.cached.clear()
                missing = words
            texts = [w.decode("utf-8", "replace") for w in missing]
            coded = self.model.encode(texts, num_threads=1)
            self.cached.update((w, (np.array(ids, dtype=np.int32), self._multi_tokens(text)))
                               for w, text, ids in zip(missing, texts, coded))
        arrays = [self.cached[w][0] for w in words]
        lengths = np.array([len(a) for a in arrays], dtype=np.int64)
        multi = np.array([self.cached[w][1] for w in words], dtype=np.int64)
        return (np.concatenate(arrays) if arrays else np.empty(0, np.int32)), lengths, multi

    def _multi_tokens(self, word: str) -> int:
        """Tokens of a word after a blank; very long words are measured in pieces, as merging one piece takes long."""
        return sum(len(self.multi.encode_ordinary((" " if k == 0 else "") + word[k:k + LONG_WORD]))
                   for k in range(0, len(word), LONG_WORD))


@cache
def rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def fertility(path: str, multi: str) -> Fertility:
    return Fertility(path, multi)


@cache
def char_classes() -> np.ndarray:
    """For every code point 0 (blank), 1 (no letter), 2 (letter, or mark on one, of no listed script), 3 and up: the scripts."""
    table = np.array([2 if unicodedata.category(chr(c))[0] in "LM" else 1 for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    for number, spans in enumerate(RANGES.values(), 3):
        for first, last in spans:
            own = table[first:last + 1]
            own[own == 2] = number
    table[[ord(c) for c in SPACES]] = 0
    return table


def repeated_words(codes: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more; windows are named exactly, by doubling."""
    if len(codes) <= WINDOW:
        return 0
    names = codes.astype(np.int64)
    for step in (1, 2, 4):
        _, names = np.unique(names[:-step] * (names.max() + 1) + names[step:], return_inverse=True)
    again = (np.bincount(names) > 1)[names]
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """The listed script most letters are of, else "other"; "unlettered" if fewer than half of the visible are letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    counts = np.bincount(char_classes()[codes], minlength=len(RANGES) + 3)
    n_letters = counts[2:].sum()
    if 2 * n_letters < n_letters + counts[1] or not n_letters:
        return "unlettered"
    best = int(counts[2:].argmax())
    return "other" if best == 0 else list(RANGES)[best - 1]


def _measure(texts: list[str], langs: list[str | None], tool: Fertility) -> list[tuple]:
    split = [t.encode("utf-8", "replace").split() for t in texts]
    numbers: dict[bytes, int] = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words in split]
    words = list(numbers)
    flat, lengths, multi = tool.tokens(words)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    results = []
    for text, lang, own in zip(texts, langs, codes):
        n_words = len(own)
        word_chars = len(text) - sum(text.count(c) for c in SPACES)
        n_repeat = repeated_words(own)
        base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
        sizes = lengths[own]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        tokens = flat[np.repeat(edges[own] - (ends - sizes), sizes) + np.arange(total)]
        if total:
            shares = np.unique(tokens, return_counts=True)[1] / total
            entropy = float(-(shares * np.log2(shares)).sum())
            chars, bytes_share = word_chars / total, float(tool.is_byte[tokens].mean())
        else:
            entropy = chars = bytes_share = 0.0
        of_multi = int(multi[own].sum())
        chars_multi = word_chars / of_multi if of_multi else 0.0
        script = main_script(text)
        band = LANGUAGES.get(lang or "", SCRIPTS[script])
        most = np.log2(min(total, len(tool.is_byte))) if total > 1 else 1.0
        inside = (band.least_chars <= chars <= band.most_chars and bytes_share <= band.most_bytes
                  and entropy >= band.least_entropy * most and chars_multi >= band.least_chars_multi)
        results.append((n_words, word_chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), n_repeat,
                        base_failed, chars, chars_multi, bytes_share, entropy, script, bool(inside and not base_failed)))
    return results


def _judging(path: str, multi: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 4 + [pa.string(), pa.bool_()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = fertility(path, multi)
        for batch in batches:
            keys, texts, langs = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in text_groups(texts):
                rows = _measure(texts[part], langs[part], tool)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([keys[part.start:part.stop], *columns], names=names)

    return run


def judge(docs: DataFrame, path: str, multi: str) -> DataFrame:
    """Counts, measures and verdict of every row; ``path``: a sentencepiece model with byte fallback, ``multi``: ranks."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), lang.alias("lang"))
    return rows.mapInArrow(_judging(path, multi), SCHEMA)
