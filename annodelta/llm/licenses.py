"""License scan by a positional index of rare licence words.

DataFrame functions only, and no shuffle but for the word statistics. Document frequencies of the licence words over all
texts give their IDF. Each template posts its words of highest IDF, with their positions; as many as make sure that a match
has two of them in place. A text's occurrences of a posted word, less its position in a template, are the starts it speaks
for; starts that two words or more of those the text has speak for are candidates. The mandatory key phrases are verified
there word by word, and the match is scored by the IDF share of template words in place.

Defined cases: null or empty text has no words and no labels; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annodelta.llm.text import lower_ascii, mark_words, whole_text

#: Phrases and their labels.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}


@dataclass(frozen=True)
class Template:
    """A notice and the phrases of it that a match must hold, each at its place."""

    label: str
    words: str
    keys: tuple[str, ...]


#: Usual licence notices and the phrases each must contain.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("hereby granted free of charge",)),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited "
             "to the warranties of merchantability", ("software is provided as is without warranty of any kind",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0",
             ("apache org licenses license 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-4", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4 0",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    *(Template(label, f"under the terms of the gnu {name} as published by the free software foundation either version {version} "
               "of the license or at your option any later version",
               (f"gnu {name} as published by the free software foundation", f"either version {version}"))
      for label, name, version in (
          ("gpl-2", "general public license", "2"), ("gpl-3", "general public license", "3"),
          ("lgpl", "lesser general public license", "2 1"), ("lgpl", "lesser general public license", "3"),
          ("agpl-3", "affero general public license", "3"))),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
             "following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("use copy modify and or distribute",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)
#: How file headers name a licence after "SPDX-License-Identifier:", in words.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "cc-by-nc": "cc by nc", "cc-by-4": "cc by 4 0", "gpl-2": "gpl 2 0",
    "gpl-3": "gpl 3 0", "lgpl": "lgpl", "agpl-3": "agpl 3 0", "mpl-2": "mpl 2 0", "bsd": "bsd", "isc": "isc",
    "unlicense": "unlicense",
}
TEMPLATES = (*NOTICES, *(Template(label, f"spdx license identifier {form}", (f"spdx license identifier {form}",))
                         for label, form in SPDX.items()))


def scan(docs: DataFrame, accept: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``accept``: least IDF share of a template's words that stand in place.
    """
    words = docs.select("doc_id", mark_words(lower_ascii(whole_text())).alias("words"))
    vocabulary = sorted({w for t in TEMPLATES for w in t.words.split()})
    idf = _idf(words, vocabulary)
    indexed = [(t, postings(t, idf, accept)) for t in TEMPLATES]
    wanted = sorted({w for _, chosen in indexed for w, _ in chosen} | {p.split()[0] for p in BASE_PHRASES.values()})
    hits = words.select("doc_id", "words", _occurrences(wanted).alias("hits"))
    base = [(label, _starts(phrase.split())) for label, phrase in BASE_PHRASES.items()]
    placed = hits.select(
        "doc_id", "words", "hits", *(starts.alias(f"_b{k}") for k, (_, starts) in enumerate(base)),
        *(_voted(t, chosen).alias(f"_t{k}") for k, (t, chosen) in enumerate(indexed)))
    scored = placed.select(
        "*", *(_best(f"_t{k}", t.words.split(), idf).alias(f"_s{k}") for k, (t, _) in enumerate(indexed)))
    places = F.array_sort(F.flatten(F.array(*(F.col(f"_b{k}") for k in range(len(base))))))
    base_labels = [F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(base)]
    own_labels = [F.when(F.col(f"_s{k}") >= accept, F.lit(t.label)) for k, (t, _) in enumerate(indexed)]
    any_base = F.size("_places") > 0
    best = F.greatest(*(F.when(F.col(f"_s{k}") >= accept, F.col(f"_s{k}")).otherwise(F.lit(0.0))
                        for k in range(len(indexed))))
    return scored.select("*", places.alias("_places")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.when(any_base, F.element_at("_places", 1)).cast("long").alias("first_word"),
        F.when(any_base, F.element_at("_places", -1)).cast("long").alias("last_word"),
        _joined(base_labels).alias("base_labels"), _joined([*base_labels, *own_labels]).alias("labels"),
        F.when(any_base, F.lit(1.0)).otherwise(best).alias("score"))


def _joined(labels: list[Column]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")


def _idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the licence words (a fixed list) over all rows; a word no text has counts as the rarest."""
    found = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    counted = words.select(F.explode(found).alias("word")).groupBy("word").count()
    total = words.count()
    seen = {row["word"]: row["count"] for row in counted.collect()}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}


def postings(template: Template, idf: dict[str, float], accept: float) -> list[tuple[str, int]]:
    """The (word, position) of highest IDF, so many that a match with at most one of them in place stays below ``accept``."""
    ordered = sorted(((w, k) for k, w in enumerate(template.words.split())), key=lambda x: (-idf[x[0]], x))
    most_lost = (1 - accept) * sum(idf[w] for w, _ in ordered)
    for n in range(2, len(ordered)):
        if sum(idf[w] for w, _ in ordered[1:n]) > most_lost + 1e-9:
            return ordered[:n]
    return ordered


def offset(template: Template, key: str) -> int:
    """Where a key phrase starts in the template, in words."""
    words, wanted = template.words.split(), key.split()
    return next(k for k in range(len(words)) if words[k:k + len(wanted)] == wanted)


def _occurrences(wanted: list[str]) -> Column:
    """(word, at) of all wanted words of a text."""
    listed = F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(w.alias("word"), i.alias("at"))))
    return F.array_compact(listed)


def _spoken_for(word: str, at: int) -> Column:
    """Starts an occurrence of ``word``, posted at ``at``, speaks for."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - F.lit(at))


def _standing(start: Column, phrase: list[str], at: int) -> Column:
    """Whether the phrase stands ``at`` words after a start."""
    return (start + at >= 0) & (
        F.slice("words", F.greatest(start + F.lit(at + 1), F.lit(1)), len(phrase)) == F.array(*map(F.lit, phrase)))


def _where_hits(starts: Column) -> Column:
    return F.when(F.size("hits") > 0, starts).otherwise(F.array().cast("array<int>"))


def _starts(phrase: list[str]) -> Column:
    """All places at which a phrase stands, looked up by its first word."""
    return _where_hits(F.filter(_spoken_for(phrase[0], 0), lambda s: _standing(s, phrase, 0)))


def _voted(template: Template, chosen: list[tuple[str, int]]) -> Column:
    """Starts of the template that two posted words or more speak for and at which all key phrases stand."""
    every = F.array_sort(F.flatten(F.array(*(_spoken_for(word, at) for word, at in chosen))))
    shifted = F.concat(F.array(F.lit(None).cast("int")), every)
    again = F.array_distinct(F.array_compact(F.zip_with(every, shifted, lambda a, b: F.when(a == b, a))))
    keys = [(key.split(), offset(template, key)) for key in template.keys]

    def verified(start: Column) -> Column:
        whole = F.lit(True)
        for phrase, at in keys:
            whole = whole & _standing(start, phrase, at)
        return whole

    return _where_hits(F.filter(again, verified))


def _best(starts: str, words: list[str], idf: dict[str, float]) -> Column:
    """The greatest IDF share of the template's words in place over its starts; 0 without any."""
    total = sum(idf[w] for w in words)

    def share(start: Column) -> Column:
        # A template may begin before the text does: such places hold no word.
        standing = [F.when((start + k >= 0) & (F.try_element_at("words", F.when(start + (k + 1) != 0, start + (k + 1)))
                                               == w), F.lit(idf[w])).otherwise(F.lit(0.0)) for k, w in enumerate(words)]
        return sum(standing, F.lit(0.0)) / F.lit(total)

    best = F.array_max(F.transform(starts, share))
    return F.least(F.lit(1.0), F.coalesce(F.when(F.size(starts) > 0, best), F.lit(0.0)))
