"""What is sent and held at once by the operators on whole texts."""

import public_tokenizers
import numpy as np
import pyarrow as pa

from annodelta.llm import packing, suffixes


def test_contexts_name_their_anchor_in_four_bytes():
    shared = "a passage of more than fifty bytes that both of these texts hold in full"
    texts = [f"first {shared} one", f"second {shared} another"]
    uid, ids, block = pa.array([11, 12]), pa.array([1, 2]), pa.array([0, 0], pa.int32())
    rows = pa.RecordBatch.from_arrays([ids, uid, block, pa.array(texts)], names=["_id", "_uid", "_block", "_text"])
    anchors = pa.Table.from_batches(suffixes._send_anchors(1, 50)(iter([rows])))
    docs = pa.Table.from_batches(suffixes._packed(iter([rows])))
    contexts = suffixes._send_contexts(1, 50)(docs, suffixes._shared_anchors(anchors))
    hashes = [suffixes.unpack_arrays(d)[0] for d in contexts["data"].to_pylist()]
    assert hashes and all(h.dtype == np.uint32 for h in hashes)
    found = [suffixes.unpack_arrays(d) for d in suffixes._repeats(50)(contexts)["data"].to_pylist()]
    assert [u for uids, _, counts in found for u, n in zip(uids, counts) for _ in range(n)] == [12] * (len(shared) + 2 - 50 + 1)


def test_texts_are_taken_out_of_a_batch_in_parts():
    texts = [f"text {n}" for n in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = list(packing._cutting(path, 1024)(iter([batch])))
    assert max(p.num_rows for p in parts) <= packing.ROWS_AT_ONCE
    assert [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(600))


def test_blobs_with_empty_arrays():
    arrays = np.empty(0, np.int64), np.arange(5, dtype=np.uint16), np.frombuffer(b"", np.uint8)
    back = suffixes.unpack_arrays(suffixes.pack_arrays(*arrays))
    assert [(a.dtype, a.tolist()) for a in back] == [(a.dtype, a.tolist()) for a in arrays]


def test_repeats_over_many_buckets(spark, monkeypatch):
    """With many buckets some get decided contexts only, of which no bytes travel."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 60)
    texts = [" ".join(f"{k}word{j}" for j in range(30)) for k in range(4)]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(16)], "doc_id long, text string").coalesce(1)
    repeats = suffixes.Repeats(docs)
    assert repeats.blocks > 50
    sizes = [len(t) for t in texts]
    assert sorted((r.doc_id, r.n_removed) for r in repeats.summary().collect()) == [(i, sizes[i % 4] if i > 3 else 0) for i in range(16)]


def test_anchors_of_a_task_are_sent_together(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 2000)
    texts = [" ".join(f"{k}word{j}" for j in range(90)) for k in range(40)]
    rows = [pa.RecordBatch.from_arrays(
        [pa.array([k]), pa.array([k + 100]), pa.array([0], pa.int32()), pa.array([t])], names=["_id", "_uid", "_block", "_text"])
        for k, t in enumerate(texts)]
    sent = list(suffixes._send_anchors(8, 50)(iter(rows)))
    assert sum(b.num_rows for b in sent) == 8


def test_contexts_of_a_hot_anchor_are_parted(monkeypatch):
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 100, (120, 60)).astype(np.uint8)
    anchor = b"the gram of the least hash, and what follows it "
    raw = [left[:n].tobytes() + anchor + right[:30].tobytes() for left, right, n in zip(letters, letters[::-1], range(20, 60))] * 3
    raw += [r[:-k] for k, r in enumerate(raw[:20], 1)] + [b"x" + r[1:] for r in raw[:30]]
    found = {}
    for data, starts, row, place, at, hashed in suffixes._windows(raw, 50):
        for s, r, a, h in zip(starts.tolist(), row.tolist(), at.tolist(), hashed.tolist()):
            found.setdefault((r, h, a), []).append(s)
    whole = b"".join(raw)
    by_anchor = {}
    for (_, h, _), s in found.items():
        by_anchor.setdefault(h, set()).add(whole[s[0]:s[-1] + 50])
    assert max(map(len, by_anchor.values())) > 20
    for bodies in map(sorted, by_anchor.values()):
        owners = rng.integers(0, 50, len(bodies))
        least = suffixes.window_classes(bodies, owners, 50)
        expected = [(m < o).tolist() for m, o in zip(least, owners.tolist())]
        for most in (76, 300, 1 << 20):
            monkeypatch.setattr(suffixes, "CHUNK", most)
            assert [x.tolist() for x in suffixes._later_in_parts(bodies, owners, 50)] == expected
