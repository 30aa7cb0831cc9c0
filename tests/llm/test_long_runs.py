"""Very long runs of one class, and the round trip that returns digests only."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from annodelta.llm import bpe, packing

RANKS, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
RUNS = [" " * 1_200_000 + "x", "\n" * 1_200_000, "a" * 200_000, "<|endoftext|>" + " " * 1_100_000]


@pytest.fixture(scope="module")
def plain():
    tool = Tokenizer.from_file(FILE)
    tool.encode_special_tokens = True
    return tool


def test_round_trip_digests(spark, docs, rows, empty, plain):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    expected = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, RANKS).collect()), key=repr) == sorted(expected, key=repr)
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_byte_bpe_takes_long_runs(spark, plain):
    frame = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    for row in bpe.round_trip(frame, RANKS).collect():
        ids = plain.encode(RUNS[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(RUNS[row.doc_id].encode()).hexdigest()


def test_packing_takes_long_runs(spark):
    tool = Tokenizer.from_file(FILE)
    frame = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    got = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.pieces(frame, FILE).collect()}
    for k, text in enumerate(RUNS):
        ids = [*tool.encode(text, add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        assert all(got[k, a] == (b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for a, b in zip(edges, edges[1:]))
