"""Every operator against a brute-force version on a small table with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from annodelta.llm import bpe, chat, fertility, fingerprints, licenses, lines, packing, suffixes, toxicity, trie

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _collect(df):
    return [tuple(r) for r in df.collect()]


def _sorted(items):
    return sorted(items, key=repr)


# 1 -------------------------------------------------------------------------------------------------------------------
def _brute_repeats(rows, length=50):
    last = 1 << 62
    owner = {}
    for i, t in rows:
        b, i = (t or "").encode(), last if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            owner[w] = min(owner.get(w, last + 1), i)
    result = []
    for i, t in rows:
        b, own = (t or "").encode(), last if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if owner[b[k:k + length]] < own:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        result.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def test_suffix_dedup(docs, rows, empty):
    assert _sorted(_collect(suffixes.Repeats(docs).summary())) == _sorted(_brute_repeats([r[:2] for r in rows]))
    assert _collect(suffixes.Repeats(empty).summary()) == []
    applied = suffixes.Repeats(docs).applied()
    assert applied.schema == docs.schema and applied.count() == len(rows)


def test_suffix_dedup_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)  # long texts are read in overlapping parts
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"{k}-{j}" for j in range(50)) + passage[k:] + "tail" * k + passage[:70 + k]) for k in range(12)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert _sorted(_collect(suffixes.Repeats(keyed).summary())) == _sorted(_brute_repeats(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(symbols):
    import numpy as np

    expected = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert suffixes.suffix_order(np.array(symbols, dtype=np.int64)).tolist() == expected


def test_suffix_order_sorts_one_word_a_suffix(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    texts = [rng.integers(1, 1 + top, n) for top in (1, 2, 5, 200) for n in (3, 4, 5, 50, 301)]
    expected = [sorted(range(len(t)), key=lambda i: t[i:].tolist()) for t in texts]
    monkeypatch.setattr(suffixes, "WORD", 8)  # columns that no word holds
    assert [suffixes.suffix_order(t).tolist() for t in texts] == expected
    monkeypatch.undo()
    monkeypatch.setattr(np, "lexsort", None)  # columns that one holds need no sort by several
    assert [suffixes.suffix_order(t).tolist() for t in texts] == expected


# 2 -------------------------------------------------------------------------------------------------------------------
def _brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return [words[k:k + 3] for k in range(len(words))]


def test_fingerprints(spark, docs, rows, empty):
    got = _collect(fingerprints.edited_fingerprints(docs))
    assert len(got) == len(rows)
    ordered = sorted(((i if i is not None else 1 << 62, t or "") for i, t, _ in rows))
    expected = []
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        expected.append((None if i == 1 << 62 else i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert _sorted(r[:3] for r in got) == _sorted(expected)
    by_id = {r[0]: r for r in got}
    assert by_id[0][3] == by_id[1][3] and by_id[2][3] == by_id[3][3] == 0
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got) and by_id[0][6] == 1.0
    assert fingerprints.edited_fingerprints(empty).count() == 0
    alone = spark.createDataFrame([(7, "just one text here")], "doc_id long, text string")
    assert _collect(fingerprints.edited_fingerprints(alone))[0][6] == 1.0


def test_within_radius(spark):
    import random

    random.seed(5)
    base = [random.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in range(7)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r[:2] for r in _collect(fingerprints.within_radius(frame, frame))}
    near = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == near and fingerprints.within_radius(frame, frame).count() == len(near)


# 3 -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference_encoding():
    with open(RANKS, "rb") as lines_:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines_)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's'tredvlmS \n\t 1２é中😀.,!_\x00", max_size=60))
def test_bpe_like_the_library(reference_encoding, text):
    assert bpe.encoder(RANKS).encode([text])[0].tolist() == reference_encoding.encode_ordinary(text)


def test_bpe_round_trip(docs, rows, empty, reference_encoding):
    got = _collect(bpe.decode(bpe.encode(docs, RANKS), RANKS))
    expected = [(i, reference_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert _sorted((r[0], r[1], bytes(r[3])) for r in got) == _sorted(expected)
    assert all(not r[2] or r[2][-1] == len(r[3]) for r in got)
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
def test_fertility(docs, rows, empty):
    paths = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: r for r in fertility.judge(docs, *paths).collect()}
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        repeated = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert got[6].kept and got[0].byte_share == 0 and got[9].script == "cjk"
    assert fertility.judge(empty, *paths).count() == 0


#: Sentences of several scripts, to be kept whatever language is given.
FLUENT = {
    "latin": "The committee met on Tuesday and agreed that the old bridge over the river should be repaired before winter, "
             "because several farmers use it every day to bring milk and grain to the market in town.",
    "cyrillic": "Комитет собрался во вторник и решил, что старый мост через реку нужно отремонтировать до зимы, потому что "
                "несколько фермеров каждый день возят по нему молоко и зерно на городской рынок. Работы начнутся летом.",
    "greek": "Η επιτροπή συνεδρίασε την Τρίτη και αποφάσισε ότι η παλιά γέφυρα πάνω από το ποτάμι πρέπει να επισκευαστεί πριν "
             "από τον χειμώνα, γιατί πολλοί αγρότες τη χρησιμοποιούν κάθε μέρα για να φέρνουν γάλα στην αγορά.",
    "arabic": "اجتمعت اللجنة يوم الثلاثاء وقررت أن الجسر القديم فوق النهر يجب أن يتم إصلاحه قبل الشتاء لأن الكثير من المزارعين "
              "يستخدمونه كل يوم لنقل الحليب والحبوب إلى السوق في المدينة القريبة من هنا",
    "hebrew": "הוועדה התכנסה ביום שלישי והחליטה כי יש לתקן את הגשר הישן מעל הנהר לפני החורף כי חקלאים רבים משתמשים בו בכל יום "
              "כדי להביא חלב ותבואה אל השוק בעיר הקרובה אליהם",
    "other": "समिति की बैठक मंगलवार को हुई और तय किया गया कि नदी पर बने पुराने पुल की मरम्मत सर्दियों से पहले की जानी चाहिए क्योंकि "
             "कई किसान हर दिन बाज़ार में दूध और अनाज लाने के लिए इसका उपयोग करते हैं",
    "cjk": " ".join(["委员会", "在", "星期二", "开会", "决定", "冬天", "以前", "修理", "河上", "的", "旧桥", "因为", "很多", "农民", "每天",
                     "用", "它", "把", "牛奶", "和", "粮食", "运到", "城里", "市场"]),
}


def test_fertility_verdicts(spark):
    rng = random.Random(4)
    private = [chr(c) for c in range(0xE000, 0xE100)]
    garbage = {
        "figures": " ".join(str(rng.randrange(10 ** 6, 10 ** 9)) for _ in range(200)),
        "marks": " ".join("".join(rng.choice("!?#$%&*+=~^@;:") for _ in range(6)) for _ in range(200)),
        "private": " ".join("".join(rng.choice(private) for _ in range(5)) for _ in range(200)),
        "rare": " ".join("".join(chr(rng.randrange(0x3400, 0x4DB0)) for _ in range(4)) for _ in range(200)),
        "hex": " ".join("%016x" % rng.getrandbits(64) for _ in range(200)),
        "figures and a letter": "a " + " ".join(str(rng.randrange(10 ** 6)) for _ in range(200)),
    }
    rows = [(name, lang, text, wanted) for texts, wanted in ((FLUENT, True), (garbage, False))
            for name, text in texts.items() for lang in (None, "xx")]
    docs = spark.createDataFrame([(k, r[2], r[1]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    paths = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in fertility.judge(docs, *paths).collect()}
    wrong = [(rows[k][:2], r.asDict()) for k, r in got.items() if r.kept != rows[k][3]]
    assert not wrong, wrong
    assert all(got[k].script == r[0] for k, r in enumerate(rows) if r[3])

    # The measures of one text, counted plainly with both libraries.
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    words = FLUENT["greek"].split()
    ids = [i for w in words for i in model.encode(w)]
    greek = next(got[k] for k, r in enumerate(rows) if r[0] == "greek")
    shares = [n / len(ids) for n in Counter(ids).values()]
    assert greek.chars_per_token == pytest.approx(sum(map(len, words)) / len(ids))
    assert greek.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert greek.token_entropy == pytest.approx(-sum(x * math.log2(x) for x in shares))
    multi = fertility.rank_encoding(paths[1])
    assert greek.chars_per_token_multi == pytest.approx(
        sum(map(len, words)) / sum(len(multi.encode_ordinary(" " + w)) for w in words))


# 5 -------------------------------------------------------------------------------------------------------------------
def _simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(prints, radius=4):
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, p in prints:
        least[find(p)].append(i)
    return {p: min((i for i in least[find(p)] if i is not None), default=None) for _, p in prints}


def test_simhash_classes(docs, rows, empty):
    prints = [(i, _simhash(t or "")) for i, t, _ in rows]
    classes = _brute_components(prints)
    got = _collect(trie.near_classes(trie.document_prints(docs)))
    assert _sorted((i, f & (1 << 64) - 1, c) for i, f, c in got) == _sorted((i, p, classes[p]) for i, p in prints)
    assert trie.near_classes(trie.document_prints(empty)).count() == 0


@pytest.mark.parametrize("unit_rows", [20_000, 12])
def test_trie_join_units(spark, unit_rows):
    import random

    random.seed(unit_rows)
    base = [random.getrandbits(64) for _ in range(12)] + [random.getrandbits(51) for _ in range(40)]
    values = sorted({b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in range(0, 9, 2)} | {0, 2**64 - 1})
    prints = list(enumerate(values))
    classes = _brute_components(prints)
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints], "doc_id long, fingerprint long")
    got = {r[0]: r[2] for r in _collect(trie.near_classes(frame, unit_rows=unit_rows))}
    assert got == {i: classes[v] for i, v in prints}


# 6 -------------------------------------------------------------------------------------------------------------------
def _brute_lines(rows):
    placed = [(i, n, x) for i, t, _ in rows if i is not None for n, x in enumerate((t or "").split("\n"))
              if re.search(r"[^\x20\x09-\x0D]", x)]
    texts = sorted({x for _, _, x in placed})
    sets = {x: {x[k:k + 8] for k in range(max(1, len(x) - 7))} for x in texts}
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first = {}
    for i, n, x in sorted(placed):
        first.setdefault(find(x), (i, n))
    return {(i, n) for i, n, x in placed if first[find(x)] != (i, n)}


def test_line_dedup(docs, rows, empty):
    got = {(r.doc_id, r.no) for r in lines.line_classes(docs).collect() if not r.stays}
    assert got == _brute_lines(rows) and (8, 0) in got and (1, 1) in got
    kept = lines.without_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[1] == "" and by_id[2] is None and by_id[8].startswith("It's") and by_id[4] == " \n\t "
    assert lines.without_lines(empty).count() == 0


def test_line_recall(spark):
    import random

    random.seed(11)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    rows, near = [], 0
    for k in range(150):
        line = random.choices(words, k=40)
        changed = list(line)
        changed[random.randrange(40)] = "changed"
        rows += [(2 * k, " ".join(line), "en"), (2 * k + 1, " ".join(changed), "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = _brute_lines(rows)
    got = {(r.doc_id, r.no) for r in lines.line_classes(frame).collect() if not r.stays}
    assert got <= expected and len(got) >= 0.97 * len(expected) and len(expected) == 150


def test_line_twins_in_a_large_family(spark):
    import random

    random.seed(12)
    letters = "abcdefghijklmnop"
    template = "".join(random.choices(letters, k=100))
    rows, shares = [], []
    for k in range(5000):
        own = "".join(random.choices(letters, k=28))
        pair = [template + own, template + own[:-11] + "".join(random.choices("QRSTUVWX", k=11))]
        x, y = ({line[i:i + 8] for i in range(len(line) - 7)} for line in pair)
        shares.append(len(x & y) / len(x | y))
        rows += [(2 * k + i, line, "en") for i, line in enumerate(pair)]
    # Twins are near enough; others share the template only.
    assert min(shares) >= 0.8 and 93 / (93 + 28 * 2) < 0.7
    got = {r.doc_id for r in lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
           if not r.stays}
    assert got <= {2 * k + 1 for k in range(5000)} and len(got) >= 0.99 * 5000


# 7 -------------------------------------------------------------------------------------------------------------------
def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = [r.asDict() for r in packing.pack(packing.pieces(docs, path)).collect()]
    expected = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            expected.append((i, n, a, b - a, zlib.crc32(raw)))
    assert _sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == _sorted(expected)
    _assert_packed(got, 1024)
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_finds_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "two  <|endoftext|>  <|endoftext|", " \n<|endoftext|>'s é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(frame, path).collect()}
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert 50256 in ids
        assert got[k] == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def _assert_packed(got, capacity):
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), min_size=1, max_size=30))
def test_plan(counts):
    got, used = [], Counter()
    for length, first, last, sequence, offset in packing.plan(counts, 64):
        assert first == used[length]
        used[length] += last - first
        got += [{"sequence_id": sequence + k, "offset": offset, "length": length} for k in range(last - first)]
    assert used == counts
    _assert_packed(got, 64)
    bins = len({g["sequence_id"] for g in got})
    assert bins <= 11 / 9 * max(-(-sum(n * c for n, c in counts.items()) // 64), sum(c for n, c in counts.items() if n > 32)) + 2


# 8 -------------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark, empty):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    fit, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    chain = toxicity.train(docs, fit, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    scored = toxicity.score(docs, chain).withColumnRenamed("toxic", "found").join(held, "doc_id")
    counts = {(r["toxic"], r["found"]): r["count"] for r in scored.groupBy("toxic", "found").count().collect()}
    recall = counts.get((1, True), 0) / (counts.get((1, True), 0) + counts.get((1, False), 0))
    clean_lost = counts.get((0, True), 0) / (counts.get((0, True), 0) + counts.get((0, False), 0))
    assert recall >= 0.9 and clean_lost <= 0.015, counts
    assert toxicity.score(empty, chain).count() == 0 and toxicity.keep_clean(empty, chain).count() == 0


def test_toxicity_without_labels(docs, rows):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    chain = toxicity.train(docs, labels, {"toxic": F.col("toxic")})
    assert toxicity.score(docs, chain).where("toxic").count() == 0
    kept = toxicity.keep_clean(docs, chain)
    assert kept.schema == docs.schema and kept.count() == len(rows)


# 9 -------------------------------------------------------------------------------------------------------------------
def test_preferences(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "hi", "a"), (1, 1, "assistant", "hello", "a"), (1, 2, "assistant", "yes", "a"),
        (2, 0, "user", "hi", "b"), (2, 1, None, None, "b"), (3, 0, "assistant", "same", "a"), (None, 0, "user", "lost", "a"),
        (4, 0, "user", "only one side", "a"),
    ], "pair long, turn long, role string, text string, key string")
    chosen = chat.conversations(turns.where("pair <> 9"), "pair")
    rejected = chat.conversations(spark.createDataFrame([
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "assistant", "no"), (1, 3, "user", "why"),
        (2, 0, "user", "hi"), (3, 0, "assistant", "same"),
    ], "pair long, turn long, role string, text string"), "pair")
    got = {r.pair: r for r in chat.format_preferences(chosen, rejected, "pair").collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_prompt_turns == 2 and one.prompt == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [one.chosen[s.start:s.start + s.length] for s in one.chosen_spans] == ["yes<|im_end|>\n"]
    assert [one.rejected[s.start:s.start + s.length] for s in one.rejected_spans] == ["no<|im_end|>\n"]
    assert got[2].chosen == "<|im_start|>unknown\n<|im_end|>\n" and got[2].rejected == "" and got[2].chosen_spans == []
    assert got[3].chosen == got[3].rejected == "" and got[3].n_prompt_turns == 1
    assert chat.format_preferences(chosen.where("false"), rejected, "pair").count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------
def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t, _ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = sorted((k, label) for label, phrase in licenses.BASE_PHRASES.items() for k in range(len(words))
                        if words[k:k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[12].labels == "gpl-3" and got[12].score > 0.9 and got[11].labels == "apache-2,cc-by-nc"
    assert licenses.scan(empty).count() == 0


def _plain_labels(texts, accept=0.7):
    """Labels and score by trying every template at every place of every text."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for i, t in texts.items()}
    seen = Counter(w for own in words.values() for w in set(own))
    idf = {w: math.log((len(texts) + 1) / (seen[w] + 1)) + 1 for t in licenses.TEMPLATES for w in t.words.split()}
    found = {}
    for i, own in words.items():
        labels = {label for label, p in licenses.BASE_PHRASES.items() if f" {p} " in f" {' '.join(own)} "}
        best = 1.0 if labels else 0.0
        for t in licenses.TEMPLATES:
            wanted = t.words.split()
            keys = [(k.split(), licenses.offset(t, k)) for k in t.keys]
            for start in range(-len(wanted), len(own)):
                if all(start + at >= 0 and own[start + at:start + at + len(k)] == k for k, at in keys):
                    share = sum(idf[w] for k, w in enumerate(wanted) if 0 <= start + k < len(own) and own[start + k] == w)
                    share /= sum(idf[w] for w in wanted)
                    if share >= accept:
                        labels.add(t.label)
                        best = max(best, share)
        found[i] = (",".join(sorted(labels)), pytest.approx(min(best, 1.0)))
    return found


def test_license_notices(spark):
    rng = random.Random(10)
    notices = {
        "gpl-3": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
                 "version 3 of the License, or (at your option) any later version.",
        "apache-2": "// SPDX-License-Identifier: Apache-2.0",
        "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
               "disclaimer.",
        "mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
               "THE WARRANTIES OF MERCHANTABILITY",
        "": "The software foundation published a license for the general public, and the warranty of any kind is as is.",
    }
    texts = dict(enumerate(notices.values()))
    filler = "the of license a software public and version under".split()
    for k in range(120):  # notices with words changed, cut at either end, or twice in a row
        own = rng.choice(licenses.TEMPLATES).words.split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(filler)
        low = rng.randrange(3)
        own = own[low:len(own) - rng.randrange(3)]
        before = [rng.choice(filler) for _ in range(rng.randrange(6))]
        texts[len(texts)] = " ".join(before + own + before + (own if k % 5 == 0 else []))
    texts[len(texts)] = "license gnu " * 30_000 + notices["gpl-3"]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert [got[k][0] for k in range(len(notices))] == list(notices)
    assert got == _plain_labels(texts)
