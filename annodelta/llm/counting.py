"""Token counts by heap-and-linked-list pair merging, without making token ids.

A text is cut at the special tokens of the tokenizer file (one token each), the rest is normalised and split into
words as the file says. The symbols of a word form a linked list, its adjacent pairs a heap by rank; the pair of lowest
rank merges, and what it joined leaves the list. A word has as many tokens as it had symbols, less its merges.

Defined cases: null text is empty and has no tokens; repeated rows are counted each; an empty table gives no rows; other
columns are ignored. Workers read the tokenizer file once; its path must be readable on every executor.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annodelta.llm.text import whole_text

#: Stretches between blanks whose counts a worker keeps, by generation; those not met again while one fills are forgotten.
CACHE_WORDS = 500_000
#: Longer ones are counted each time they come, so that the cache has a bound in bytes.
CACHED_CHARS = 64
PLACE_BITS = 40


@cache
def _unassigned() -> re.Pattern[str]:
    """Code points that this Unicode version does not know; versions disagree on their classes."""
    codes = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    firsts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], -1]) if c + 1 != after]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)) + "]")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def has_unassigned(text: str) -> bool:
    return not text.replace("\n", " ").isprintable() and _unassigned().search(text) is not None


class WordCounter:
    """Counts the tokens of texts for a byte-level BPE file with word ends (normaliser: NFC, white space, lower case)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, kinds = rules["model"], [step["type"] for step in rules["normalizer"]["normalizers"]]
        split = rules["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a word-end vocabulary of lower-cased text")
        self.tool = Tokenizer.from_file(path)
        self.words = regex.compile(split["pattern"]["Regex"])
        specials = [token["content"] for token in rules["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or "(?!)")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.letter_bytes = {letter: b for b, letter in enumerate(letters)}
        self.inner = [vocabulary[letter] for letter in letters]
        self.last = [vocabulary[letter + model["end_of_word_suffix"]] for letter in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[vocabulary[left] << 20 | vocabulary[right]] = rank, vocabulary[left + right]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def symbols_left(self, word: bytes) -> int:
        """Symbols of a word after all merges."""
        size, merges = len(word), self.merges
        held = [self.inner[b] for b in word]
        held[-1] = self.last[word[-1]]
        after, before = list(range(1, size + 1)), list(range(-1, size))
        heap = [found[0] << PLACE_BITS | place for place in range(size - 1)
                if (found := merges.get(held[place] << 20 | held[place + 1]))]
        heapq.heapify(heap)
        left, place_mask = size, (1 << PLACE_BITS) - 1
        while heap:
            entry = heapq.heappop(heap)
            place = entry & place_mask
            other = after[place]
            if held[place] < 0 or other == size:
                continue
            found = merges.get(held[place] << 20 | held[other])
            if found is None or found[0] != entry >> PLACE_BITS:
                continue  # one of the two has merged since
            left -= 1
            held[place], held[other] = found[1], -1
            following = after[place] = after[other]
            before[following] = place
            if following < size and (found := merges.get(held[place] << 20 | held[following])):
                heapq.heappush(heap, found[0] << PLACE_BITS | place)
            preceding = before[place]
            if preceding >= 0 and (found := merges.get(held[preceding] << 20 | held[place])):
                heapq.heappush(heap, found[0] << PLACE_BITS | preceding)
        return left

    def _stretches(self, part: str) -> list[str]:
        """Normalised text between special tokens, cut at blanks and line ends, which no word holds."""
        if not part.isascii():
            if has_unassigned(part):
                part = self.tool.normalizer.normalize_str(part)
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case letter by letter, not by place
        return part.lower().replace("\n", " ").split(" ")

    def _words_of(self, stretch: str) -> list[bytes]:
        if has_unassigned(stretch):
            shown = (word for word, _ in self.tool.pre_tokenizer.pre_tokenize_str(stretch))
            return [bytes(self.letter_bytes[c] for c in word) for word in shown]
        return [word.encode() for word in self.words.findall(stretch)]

    def count(self, text: str) -> int:
        total, at = 0, 0
        for special in self.specials.finditer(text):
            total += 1 + self._count_words(text[at:special.start()])
            at = special.end()
        return total + self._count_words(text[at:] if at else text)

    def _count_words(self, part: str) -> int:
        stretches = self._stretches(part)
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        known = self.young
        rare: dict[str, int] = {}
        for stretch in set(stretches).difference(known):
            number = self.old.get(stretch)
            if number is None:
                number = sum(map(self.symbols_left, self._words_of(stretch)))
            (known if len(stretch) <= CACHED_CHARS else rare)[stretch] = number
        if rare:
            return sum(rare[stretch] if stretch in rare else known[stretch] for stretch in stretches)
        return sum(map(known.__getitem__, stretches))


@cache
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = [own.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text"))
    counted = rows.mapInArrow(_counting(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
