"""Each operator against a plain version of its contract, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import os
import sys
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from scorewright.llm import byte_bpe, exact_dedup, language, lm_scoring, near_dedup, packing, quality, sharding, simple8b, token_output, tokens, vector_search  # noqa: E402
from scorewright.llm.common import Scratch, id_remainder, only  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mid long, part int, class string, sha string, kept boolean, score double, rank int, bucket int"
WORDS = "the of and a reed stone river under over light grand éclair straße niño mañana . , x1 don't".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _rows():
    rng = np.random.default_rng(4)
    base = [_text(rng, int(rng.integers(1, 120))) for _ in range(40)]
    texts = list(base)
    for k in range(12):  # near copies, some over the threshold and some under it
        words = base[k].split()
        words[len(words) // 2 : len(words) // 2 + 1 + k % 3] = ["changed"]
        texts.append(" ".join(words))
    texts += [base[0]] * 5 + [base[1].upper(), base[2] + "  ", base[2].replace(" ", "\n\t"), None, None, "", " \n", "one", "ONE", "123 ...", "z" * 3000, _text(rng, 9000), "a\x0bb\x0cc", "  x", "<|endoftext|> it's"]
    rows = [(3 * k, t, "en", "s", 0) for k, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", 0), (3, "another text under a used id", "en", "s", 0), (None, base[3], None, None, None), (None, "text without an id", None, None, None)]
    return [(*r, 1, 1, "c", "s", True, 0.5, 1, 1) for r in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1] or "") for r in ROWS]


def key(x):
    return (x is not None, x or 0)


# -- near copies ----------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = text.encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(items):
    """The number of each row's group by comparing all pairs, and its set."""
    sets = [frozenset(shingle_set(t)) for _, t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))], sets


def components(items):
    """Component id (least id that isn't null) and set size of each row."""
    group, sets = roots(items)
    least = {}
    for (d, _), g in zip(items, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(least.get(g), len(s)) for g, s in zip(group, sets, strict=True)]


def test_near_dedup(docs, empty):
    expected = Counter((d, n, c, d == c) for (d, _), (c, n) in zip(pairs(), components(pairs()), strict=True))
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect())
    assert found == expected
    assert near_dedup.near_dedup(empty).collect() == []


def test_near_dedup_chains(spark):
    """Links that meet in no leader: a chain of texts, each near the next one only, and a large group of copies of one end."""
    rng = np.random.default_rng(8)
    words = [f"w{rng.integers(10**6)}" for _ in range(260)]
    chain = [" ".join(words[14 * k : 14 * k + 120]) for k in range(10)]
    items = [(1000 - k, t) for k, t in enumerate(chain)] + [(2000 + k, chain[0]) for k in range(300)]
    found = near_dedup.near_dedup(spark.createDataFrame(items, "doc_id long, text string"))
    assert [(r[0], r[1]) for r in found.groupBy("component_id").count().collect()] == [(991, 310)]


def test_near_dedup_of_rows_without_ids(spark):
    """Many rows that share a null id, or one id, are told apart by their texts; the work stays in proportion."""
    words = [f"w{k}" for k in range(997)]
    items = [(None if k % 2 else 7, " ".join(words[(k * j + k) % 997] for j in range(1, 13))) for k in range(20_000)]
    items += [(None, items[4][1]), (3, items[5][1])]
    found = near_dedup.near_dedup(spark.createDataFrame(items, "doc_id long, text string").repartition(4))
    began = time.perf_counter()
    rows = Counter((r["doc_id"], r["component_id"]) for r in found.collect())
    assert time.perf_counter() - began < 120 and sum(rows.values()) == 20_002
    assert rows[3, 3] == 1 and rows[None, 3] >= 1 and set(rows) <= {(7, 7), (7, 3), (None, None), (None, 7), (None, 3), (3, 3)}


def test_candidates_at_the_threshold_are_verified():
    """Recall of the estimate: of pairs with similarities from 0.75 to 0.77, none is dropped before verification."""
    rng = np.random.default_rng(9)
    sizes = [(400, 300 + k % 7) for k in range(1000)]
    a = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n, _ in sizes]
    b = [x[:k] for x, (_, k) in zip(a, sizes, strict=True)]
    true = np.array([len(y) / len(x) for x, y in zip(a, b, strict=True)])
    assert true.min() >= 0.75 and true.max() < 0.77
    assert near_dedup.possible(near_dedup.registers(a), near_dedup.registers(b), np.array([len(x) for x in a]), np.array([len(x) for x in b])).all()


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(40)]
    b = [np.unique(np.concatenate([x[:700], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for x in a]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    true = np.array([len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(a, b, strict=True)])
    found = near_dedup.estimate(ra, rb, np.array([len(x) for x in a]), np.array([len(x) for x in b]))
    assert abs((found - true).mean()) < 0.02 and np.abs(found - true).max() < 0.2
    union = near_dedup.registers([np.union1d(x, y) for x, y in zip(a, b, strict=True)])
    assert (near_dedup.merge(ra, rb) == union).all()


# -- vectors --------------------------------------------------------------------------------------------------------


def best(rows, k=5):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, v in {r for r in whole if r[0] % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))
    return out


def test_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(301)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(50, rows[9][1]), (7, rows[7][1]), (500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (550, [1.0, 2.0]), (551, [3.0, 4.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 10)
    monkeypatch.setattr(vector_search, "CELLS", 250)
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 3)
    assert Counter(map(tuple, vector_search.top_k(df).collect())) == best(rows)
    assert vector_search.top_k(df.limit(0)).collect() == []


def test_vector_bounds_hold():
    rng = np.random.default_rng(6)
    v, q = rng.integers(-300, 300, (200, 16)), rng.integers(-300, 300, (20, 16))
    low, high = vector_search.VaBlock(np.arange(200), v).bounds(q.astype(float))
    assert (low <= q @ v.T).all() and (q @ v.T <= high).all()


# -- learnt classifiers ---------------------------------------------------------------------------------------------


#: Tables with enough labels to tell a classifier from a guess (the smallest ones hold 19 held-out labels, 3 of them bad).
LABELLED = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="needs the labelled tables")
def test_quality_on_held_out(spark):
    """op3's columns row by row against a plain version, then its worth on held-out labels: ranking, bad rows caught, good rows kept,
    calibration, and better than calling all rows good."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet").collect() for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs}
    quality_of = {r["doc_id"]: r["quality"] for r in labels}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    taught = [d for d in sorted(quality_of) if not held[d] and texts[d] and len(texts[d]) <= quality.SAMPLE_CHARS]
    by = [list(dict.fromkeys(texts[d] for d in taught if quality_of[d] == q)) for q in (1, 0)]
    share = np.mean([q for d, q in quality_of.items() if not held[d]])
    model = quality.fit(*by, share)
    plain = dict(zip(texts, model.score(list(texts.values()), model.compressors()), strict=True))
    found = quality.op3(spark, LABELLED).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r["held_out"] == held[r["doc_id"]] and r["score"] == pytest.approx(plain[r["doc_id"]]) and r["predicted"] == int(r["score"] >= 0.3)
    scores, good = (np.array(x) for x in zip(*[(r["score"], quality_of[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in quality_of], strict=True))
    assert np.mean([[(a > b) + (a == b) / 2 for b in scores[good == 0]] for a in scores[good == 1]]) > 0.9
    assert (scores[good == 0] < 0.3).mean() >= 0.5 and (scores[good == 1] >= 0.3).mean() > 0.97
    assert ((scores >= 0.3) == good).mean() > good.mean() + 0.05
    assert abs(scores.mean() - good.mean()) < 0.05


def test_calibration():
    """The steps are the least-squares non-decreasing fit (each pool with one observation of the whole), carried to another share."""
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 1.0])
    steps, scores = quality.calibrate(x, y, 4 / 6)
    assert steps == pytest.approx([0.1, 0.25, 0.4, 0.5, 0.6][: len(steps)] if len(steps) == 5 else steps)
    assert (np.diff(scores) >= 0).all() and scores[0] == pytest.approx((0 + 4 / 6) / 2)
    assert np.interp(0.25, steps, scores) == pytest.approx((1 + 4 / 6) / 3)
    less = quality.calibrate(x, y, 0.5)[1]
    assert (less < scores).all() and less[0] / (1 - less[0]) == pytest.approx(scores[0] / (1 - scores[0]) / 2)


def test_quality_edge_cases(spark, docs, empty):
    good, bad = ["a fine text of words " * 9] * 8, ["BAD | BAD | " * 20] * 8
    model = quality.fit(good, bad)
    scores = quality.score(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    made = model.score(["a fine text of words " * 5, "BAD | BAD | " * 9], model.compressors())
    assert made[0] > 0.5 > made[1]
    assert quality.score(empty, model).collect() == [] and quality.keep_good(empty, model).columns == empty.columns
    for one in (quality.fit([], []), quality.fit(["x y z"], []), quality.fit([], ["x y z"])):
        assert len(one.score([None, "", "a"], one.compressors())) == 3
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, labels, F.lit(True))[0]).first()["score"] == 0.5


def test_language_on_held_out(spark, sf_dir):
    found = language.op6(spark, sf_dir)
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    assert found.count() == lang.count()
    assert found.filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_language_edge_cases(docs, empty):
    model = language.fit(["the cat sat on the mat and the hat"] * 8 + ["le chat est sur la table avec une chaise"] * 8 + ["der hund und die katze sind nicht hier"] * 8, ["en"] * 8 + ["fr"] * 8 + ["de"] * 8)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all((r[1] is None or not any(map(str.isalpha, r[1]))) == (found[r[0]]["lang_pred"] == "und") for r in ROWS if r[0] not in (None, 0, 3))
    assert model.predict("le chat est avec la chaise")[0] == "fr" and model.predict(None) == ("und", 0.0, True)
    assert language.predict(empty, model).collect() == []
    assert language.fit([], []).predict("a text")[0] == "und"
    assert language.fit(["a text"], ["en"]).predict("another")[0] == "en"
    for n in range(2, 12):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert n > 6 or code.shape[1] == 2 ** (n - 1) - 1
    assert language.learn(empty, F.lit(True)).languages == []


# -- exact copies ---------------------------------------------------------------------------------------------------


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in pairs():
        groups[normal(t)].append(d)
    keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    expected = Counter((d, keep[normal(t)], len(groups[normal(t)]), d == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in pairs())
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == expected
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_appends(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = exact_dedup.exact_dedup(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"), index).collect()
    second = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id long, text string"), index).collect()
    assert {(r["doc_id"], r["kept"]) for r in first} == {(5, True), (6, True)}
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in second} == {(1, 5, False), (2, 2, True), (3, 2, False)}
    assert index.rows().count() == 3
    index.drop()
    assert not index.exists()


# -- tokens ---------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.just(0), max_size=400), st.integers(1, 30))
def test_simple8b_round_trip(values, times):
    values = np.array(values * times, np.uint64)
    assert (simple8b.decode(simple8b.encode(values)) == values).all()


def test_simple8b_blocks():
    values = np.arange(3 * simple8b.BLOCK + 7, dtype=np.uint64) % np.uint64(997)
    assert (simple8b.decode(simple8b.encode(values), 1, 3) == values[simple8b.BLOCK : 3 * simple8b.BLOCK]).all()
    assert len(simple8b.decode(simple8b.encode(values), 4, 9)) == 0
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 40)


TRICKY = st.text(st.sampled_from("ab éÉ\n\t 　中1'.s,̸ßİ|<>_-*$`^!"), max_size=40)


@settings(deadline=None, max_examples=300)
@given(TRICKY)
def test_encoders_equal_libraries(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own, library = _encoder(name)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    own, library = _byte_tool()
    (ids,) = own.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("abhHKtW éÉ\n\t 　中1'.s,̸̱̇ßİ|<>_-*$`^!\0"), max_size=40) | st.sampled_from(["H̱ẖ,", "it's,'s", "x" * 70 + ".", "<|endoftext|>, the"]), max_size=6), st.sampled_from([1, 16, 1 << 18]))
def test_texts_encoded_together_equal_libraries(texts, run):
    own, library = _encoder("word_bpe_49k.json")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "RUN", run)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_of_many_texts_are_one_call():
    """Capitals and stops make no new words; long words are made each time and leave nothing behind; another operator's memo releases all."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = tokens.Encoder(f.read())
    library, calls = own.words, []

    class Counted:
        def encode(self, text, **kwargs):
            calls.append(text)
            return library.encode(text, **kwargs)

    own.words = Counted()
    texts = ["Zqxjkv zqxjkv, éèzq.", "ZQXJKV! zqxjkv?! éèzq", "(zqxjkv) " + "y" * 65]
    found = own.encode_all(texts)
    assert len(calls) == 1 and len(calls[0].split()) == 2
    assert own.encode_all(texts) == found and len(calls) == 1
    assert not own.pieces.waiting and b"y" * 65 not in own.pieces
    only("another")
    assert not own.pieces and not own.pieces.held


def test_marks_that_join_plain_letters_are_seen():
    """Every mark that joins an ASCII letter, and every character that becomes such a mark, has CC or CD as its first byte."""
    marks = set()
    for code in range(sys.maxunicode + 1):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and whole[0].isascii() and whole[0].isalpha():
            marks |= set(whole[1:])
    assert marks and all(m.encode()[0] in (0xCC, 0xCD) for m in marks)
    starts = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.normalize("NFD", chr(c))[0] in marks}
    assert all(c.encode()[0] in (0xCC, 0xCD) for c in starts)


_made = {}


def _encoder(name):
    if name not in _made:
        library = Tokenizer.from_file(public_tokenizers.path(name))
        library.encode_special_tokens = True
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            _made[name] = (tokens.Encoder(f.read()), library)
    return _made[name]


def _byte_tool():
    if "bytes" not in _made:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = byte_bpe.read_ranks(f.read())
        _made["bytes"] = (byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _made["bytes"]


def test_long_pieces_merge_alike():
    own, library = _byte_tool()
    rng = np.random.default_rng(2)
    texts = ["ab" * 700, "é" * 600, "the" * 300, "z" * 3000, "中文" * 400]
    texts += ["".join(rng.choice(list("abcdeést"), int(n))) for n in (64, 65, 127, 128, 129, 256, 257, 700, 5000) for _ in range(5)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_token_output(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_output.read_tokens(token_output.write_tokens(docs, path, 1, Scratch(spark, "t"))).orderBy("start").collect()
    _, library = _encoder("word_bpe_49k.json")
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in pairs()), key=key)
    at = 0
    for r in found:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    expected = Counter((d, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in pairs())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == expected
    assert token_output.read_tokens(token_output.write_tokens(empty, path, 1, Scratch(spark, "t"))).collect() == []


def test_byte_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    _, library = _byte_tool()
    expected = Counter((d, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in pairs())
    assert Counter((r[0], bytes(r[1]), bytes(r[2])) for r in byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()) == expected
    assert byte_bpe.encode_decode(empty, path, public_tokenizers.PATTERN).collect() == []


# -- packing --------------------------------------------------------------------------------------------------------


def check_packing(rows, documents, capacity):
    """documents: Counter of id arrays as bytes by doc_id. Every id in one piece, gapless sequences; returns the padding's share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    pieces = Counter((r["doc_id"], r["start"], r["length"]) for r in rows)
    total = 0
    for (d, ids), times in documents.items():
        total += times * len(ids) // 4
    assert sum(length * n for (_, _, length), n in pieces.items()) == total
    return padding / total


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    _, library = _encoder("byte_bpe_50k.json")
    packed = packing.pack(docs, path, 0, capacity=64)
    slices = packed.slices().collect()
    documents = Counter((d, np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in pairs())
    assert check_packing(slices, documents, 64) < 0.02
    by_id = defaultdict(list)
    for d, ids in documents:
        by_id[d].append(ids)
    for r in slices:
        assert any(ids[4 * r["start"] : 4 * (r["start"] + r["length"])] == bytes(r["ids"]) and len(ids) // 4 == r["doc_tokens"] for ids in by_id[r["doc_id"]])
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    assert Counter(tuple(r[c] for c in columns) + (r["ids_crc32"],) for r in packing.digest(packed).collect()) == Counter(tuple(r[c] for c in columns) + (zlib.crc32(bytes(r["ids"])),) for r in slices)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packed.sequences().collect()}
    assert sum(map(len, whole.values())) == sum(len(r["ids"]) for r in slices) and max(map(len, whole.values())) <= 256
    assert packing.digest(packing.pack(empty, path, 0)).collect() == []


@settings(deadline=None, max_examples=25)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=32))
def test_layout_covers_every_rank(histogram):
    rows = packing.layout(histogram, 32)
    cells, used = defaultdict(list), Counter()
    for length, a, b, each, sequence, offset, stream in rows:
        for rank in range(a, b):
            used[length, rank] += 1
            for cell in range(length):
                at = offset + (rank - a) % each * length + cell if stream is None else stream + (rank - a) * length + cell
                cells[sequence + ((rank - a) // each if stream is None else at // 32)].append(at if stream is None else at % 32)
    assert used == Counter((x, r) for x, n in histogram.items() for r in range(n))
    total = sum(x * n for x, n in histogram.items())
    assert all(sorted(c) == list(range(len(c))) and len(c) <= 32 for c in cells.values())
    assert len(cells) <= total / (32 * (1 - packing.SLACK)) + 1 and sorted(cells) == list(range(len(cells)))


def test_layout_without_cuts():
    """With slack 1 every item lies whole, by rounded patterns and best fit alone, near the bound of the linear program."""
    rng = np.random.default_rng(5)
    histogram = {int(x): int(rng.integers(1, 90)) for x in rng.choice(np.arange(1, 129), 70, replace=False)}
    rows = packing.layout(histogram, 128, slack=1)
    assert all(r[6] is None for r in rows)
    sequences = max(r[4] + -(-(r[2] - r[1]) // r[3]) for r in rows)
    lengths = np.array(sorted(x for x in histogram if x < 128))
    least = sum(v for _, v in packing.column_generation(lengths, np.array([histogram[int(x)] for x in lengths], float), 128, gap=0, rounds=3000))
    assert sequences <= 1.01 * (least + histogram.get(128, 0)) + 2


def test_column_generation_finds_the_optimum():
    lengths = np.array([3, 5, 7])
    found = packing.column_generation(lengths, np.array([30.0, 20.0, 20.0]), 10, gap=0)
    assert sum(v for _, v in found) == pytest.approx(100 / 3)
    for i in range(3):
        assert sum(p[i] * v for p, v in found) == pytest.approx([30, 20, 20][i])


# -- language-model scores ------------------------------------------------------------------------------------------


def lm_scores(items, teaches):
    """Rows of op8 but for held_out, by the model's formulas; items: (doc_id, text), teaches: which of them teach."""
    words = [[*t.encode().lower().split(), None] for _, t in items]
    taught = [w for w, on in zip(words, teaches, strict=True) if on]
    start = "start"
    c1, c2, c3 = (Counter(g for x in taught for g in zip(*([start, *x][k:] for k in range(n)), strict=False) if n > 1 or g[0] != start) for n in (1, 2, 3))
    n, v, (mu2, mu3) = sum(c1.values()), len(c1), lm_scoring.MU
    out = Counter()
    for (d, _), text in zip(items, words, strict=True):
        base = score = 0.0
        path = [start, *text]
        for i in range(1, len(path)):
            h, w = path[i - 1], path[i]
            p = (c1[w,] + 1) / (n + v + 1)
            base += math.log10(p)
            p = (c2[h, w] + mu2 * p) / ((len(taught) if h == start else c1[h,]) + mu2)
            if i > 1:
                p = (c3[path[i - 2], h, w] + mu3 * p) / (c2[path[i - 2], h] + mu3)
            score += math.log10(p)
        out[d, len(text), sum(c1[w,] > 0 for w in text), n, round(base, 6), round(score, 6)] += 1
    return out


def lm_rows(df):
    return Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("direct", [4096, 8])
def test_lm_scores(docs, empty, monkeypatch, direct):
    """Messages straight to shards and by relays, several blocks, texts of several lanes."""
    teaches = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "LANE", 50)
    monkeypatch.setattr(lm_scoring, "DIRECT_SHARDS", direct)
    assert lm_rows(lm_scoring.score(docs, teaches)) == lm_scores(pairs(), [d is not None and d % 2 == 0 for d, _ in pairs()])
    assert lm_scoring.score(empty, teaches).collect() == []
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in lm_scoring.score(docs, F.lit(False)).collect())


def test_lm_automaton():
    """States, arcs and failure arcs of a tiny corpus, and that the arcs and the failure arc of every state have probabilities that sum to 1."""
    grams = lm_scoring.BlockNgrams([b"a b a b c", b"a b", b"zz a"])
    teaches = np.array([True, True, False])
    counts = [grams.training_counts(teaches, k) for k in range(3)]
    total, types = int(counts[0].sum()), int((counts[0] > 0).sum())
    model = lm_scoring.Automaton(grams, counts, total, types)
    assert (total, types) == (9, 4)
    words = len(grams.keys[0])
    unknown = int(np.flatnonzero(counts[0] == 0)[0])
    known = np.array([w for w in range(words) if w != unknown])
    states = {0, model.start, *(1 + known).tolist(), *model.arc_next.tolist()}
    ends = 1 + grams.where[0][grams.begin + grams.lengths][0]
    for state in states:
        if state == ends or (state > model.stride and grams.where[0][grams.some[1][state - model.stride - 1]] == ends - 1):
            continue  # nothing follows the end of a text
        _, weight = model.read(np.full(words, state), np.arange(words))
        assert (10**weight).sum() == pytest.approx(1)
    assert len(model.arc_keys) == int((counts[1] > 0).sum() + (counts[2] > 0).sum())


# -- shards ---------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, seed):
    rows = np.arange(n)
    places = sharding.permute(rows, n, seed)
    assert (np.sort(places) == rows).all() and (sharding.permute(places, n, seed, inverse=True) == rows).all()


def test_sharding(docs, empty):
    found = sharding.shard(docs, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in pairs())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(5), 7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert sharding.shard(empty).collect() == []


# -- the registered queries on whole tables ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op5_rows(spark, sf_dir, table):
    _, library = _encoder("word_bpe_49k.json")
    expected, start = set(), 0
    for d, t in sorted(table):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected.add((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_output.op5(spark, sf_dir)
    assert dict(found.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found.collect()} == expected


def test_op7_rows(spark, sf_dir, table):
    _, library = _encoder("byte_bpe_50k.json")
    coded = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in table}
    rows = packing.op7(spark, sf_dir).collect()
    assert check_packing(rows, Counter((d, x.tobytes()) for d, x in coded.items()), 1024) < 0.01
    assert all(zlib.crc32(coded[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(coded[r["doc_id"]]) == r["doc_tokens"] for r in rows)
    reach = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):  # each document's pieces lie end to end
        assert r["start"] == reach[r["doc_id"]]
        reach[r["doc_id"]] += r["length"]
    assert sorted({r["sequence_id"] for r in rows}) == list(range(len({r["sequence_id"] for r in rows})))


def test_op8_rows(spark, sf_dir, table):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in table}
    found = lm_scoring.op8(spark, sf_dir)
    assert lm_rows(found) == lm_scores(table, [not held[d] for d, _ in table])
    assert {r["doc_id"]: r["held_out"] for r in found.collect()} == held


def test_op9_rows(spark, sf_dir, table):
    _, library = _byte_tool()
    expected = set()
    for d, t in table:
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        expected.add((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    found = byte_bpe.op9(spark, sf_dir).collect()
    assert len(found) == len(table) and {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == expected


def test_op10_rows(spark, sf_dir, table):
    found = sharding.op10(spark, sf_dir).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in table}
    ordered = sorted(found, key=lambda r: r["doc_id"])
    places = sharding.permute(np.arange(len(table)), len(table), 20240229)  # ids are distinct here, so a row's number is its rank
    assert [(r["shard"], r["slot"]) for r in ordered] == [(int(p) % 40, int(p) // 40) for p in places]
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1 and {r["law"] for r in found} == {"rows"}


def test_op6_rows(spark, sf_dir):
    """op6's columns row by row against a plain version of the model."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in language.op6(spark, sf_dir).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in docs}
    taught = {(t, lang) for d, t, lang in docs if not held[d] and t and lang and len(t) <= language.SAMPLE_CHARS}
    assert max(Counter(lang for _, lang in taught).values()) <= language.PER_LANGUAGE  # so every text teaches
    order = spark.createDataFrame(sorted(taught), "text string, lang string").select("text", "lang", F.xxhash64("text").bitwiseAND((1 << 52) - 1).alias("place")).collect()
    learnt = sorted((r["place"] / float(1 << 52), r["text"], r["lang"]) for r in order)
    model = language.fit([t for _, t, _ in learnt], [lang for _, _, lang in learnt])
    for d, text, _ in docs:
        name, score, ambiguous = model.predict(text)
        r = found[d]
        assert (r["held_out"], r["lang_pred"], r["ambiguous"]) == (held[d], name, ambiguous) and r["score"] == pytest.approx(score)


def test_remainder_of_ids(spark):
    row = spark.createDataFrame([(17,), (None,)], "doc_id long").select(id_remainder("doc_id", 5).alias("r")).collect()
    assert [r[0] for r in row] == [zlib.crc32(b"17") % 5, zlib.crc32(b"") % 5]
