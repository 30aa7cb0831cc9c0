from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annodelta.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["▁ marked", " ", "  two  spaces \n\n new", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 null", "é́ 日本 🇩🇪👩‍👩‍👧",
           "tab\tand\r\nreturn", "a" * 2000, " " * 500 + "end", "x" * 30 + " " + "y" * 30, "123 4567 89"]


def brute_force(texts: list[str | None]) -> list[tuple]:
    """All overlapping token pairs, found by comparing every two byte ranges of a text."""
    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {letter: b for b, letter in enumerate(alignment_letters())}
    rows, counts = [], Counter()
    for text in texts:
        a = tool.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        a_bytes = [bytes(shown[c] for c in tool.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
                   else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            rows.append(None)
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if max(a_ends[i], b_ends[j]) < min(a_ends[i + 1], b_ends[j + 1]):
                    links.append((x, y))
        counts.update(links)
        shared = sorted(set(a_ends) & set(b_ends))
        groups = []
        for low, high in zip(shared, shared[1:]):
            own = [[t for t, e in zip(ids, stops[1:]) if low < e <= high] for ids, stops in ((a, a_ends), (b, b_ends))]
            groups.append("|".join(",".join(map(str, ids)) for ids in own))
        rows.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]),
             hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


def alignment_letters() -> list[str]:
    from annodelta.llm.counting import byte_letters

    return byte_letters()


def ends(tokens: list[bytes]) -> list[int]:
    found = [0]
    for token in tokens:
        found.append(found[-1] + len(token))
    return found


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))


def test_against_brute_force(spark, docs, rows):
    more = spark.createDataFrame([(100 + k, t, "x", "s", 0, "w", 0.0) for k, t in enumerate(AWKWARD)], docs.schema)
    texts = [(i, t) for i, t, _ in rows] + [(100 + k, t) for k, t in enumerate(AWKWARD)]
    expected = in_order((i, *r) for (i, _), r in zip(texts, brute_force([t for _, t in texts])))
    for most in (1, 4000, alignment.CHUNK_CHARS):  # many small chunks give what one gives
        assert in_order(alignment.align_documents(docs.union(more), A, B, most).collect()) == expected


def test_empty_table(empty):
    assert alignment.align_documents(empty, A, B).count() == 0


def test_very_long_texts():
    own = alignment.Aligner(A, B)
    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    for text in (" " * 300_000, "\n" * 1_200_000, "ab " * 50_000):
        assert own.byte_ids(text).tolist() == tool.encode(text, add_special_tokens=False).ids
    held = alignment.Chunk(own)
    held.add([1, 2], ["word " * 30_000, "\n" * 1_200_000])
    row = held.row(7).to_pylist()[0]
    assert row["n_a"][0] == 30_001 and row["n_b"][0] == 30_001 and row["n_groups"] == [30_001, row["n_a"][1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "  ", "\n", " the", "ing", " \n ", "'s", " 12", "▁"]))))
def test_ids_from_stretches_are_those_of_the_whole_text(parts):
    text, own = "".join(parts), alignment.aligner(A, B)
    stretches = alignment._BREAK.split(" " + text)
    a, _, b, _ = own.tokenise(stretches)
    if text and "▁" not in text:  # such a text has no tokens
        assert a.tolist() == byte_ids(text)
        assert b.tolist() == own.pieces.encode(text)


def byte_ids(text):
    tool = Tokenizer.from_file(A) if not TOOLS else TOOLS[0]
    tool.encode_special_tokens = True
    TOOLS[:] = [tool]
    return tool.encode(" " + text, add_special_tokens=False).ids


TOOLS: list[Tokenizer] = []


def test_small_batches(monkeypatch):
    own = alignment.aligner(A, B)
    stretches = [" some", " unusually", " ", "  tokenised", " wordings,\n", " ▁x", " 日本"]
    whole = own.tokenise(stretches)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 1)
    for one, other in zip(whole, own.tokenise(stretches)):
        assert one.tolist() == other.tolist()
    assert (whole[1] > 0).tolist() == [True] * 5 + [False, True]
