"""Piece encoding against its library, the trie of conversations and collocations against plain versions of their contracts."""

import hashlib
import math
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from scorewright.llm import phrases, piece_bpe, prefix_trie  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tool():
    with open(MODEL, "rb") as f:
        return piece_bpe.PieceBpe(f.read())


def packed(ids):
    return array("I", ids).tobytes()


# -- pieces ---------------------------------------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeéßñ .,▁\n\t '0123<>/_-=(){};ABCthe中文😀\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_the_library(tool, library, text):
    ids = library.encode(text)
    assert tool.encode(text) == packed(ids)
    assert tool.decode(packed(ids)) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=12))
def test_any_ids_are_decoded(tool, library, ids):
    assert tool.decode(packed(ids)) == library.decode(ids)


def test_prefix_table(tool, library):
    """The last piece of every prefix is that of the prefix encoded alone, and two pieces of an encoding stay apart."""
    text = "▁internationalisations,unbelievably(thereof)"
    assert tool.last_pieces(text) == [library.encode(text[1:end], out_type=str)[-1] if end > 1 else "▁" for end in range(1, len(text) + 1)]
    assert tool.apart("", "▁the") and not tool.apart("▁t", "he")


def test_long_stretches_take_time_in_proportion(tool, library):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh"), 300_000).tolist())
    for text in (long, " " * 100_000, "ab" * 100_000):
        began = time.perf_counter()
        assert tool.encode(text) == packed(library.encode(text))
        assert time.perf_counter() - began < 20


def test_verdicts_are_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "VERDICTS", 50)
    with open(MODEL, "rb") as f:
        small = piece_bpe.PieceBpe(f.read())
    text = " ".join(f"word{k} another{k * 7}" for k in range(300))
    assert small.encode(text) == packed(library.encode(text))
    assert sum(map(len, small.tables)) <= 50


def test_piece_rows(spark, library):
    from test_operators import ROWS, SCHEMA

    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in piece_bpe.encode_decode(docs, MODEL).collect())
    ids = [(r[0], [*library.encode(r[1] or ""), 2]) for r in ROWS]
    assert found == Counter((d, tuple(i), library.decode(i)) for d, i in ids)
    assert piece_bpe.encode_decode(docs.limit(0), MODEL).collect() == []


def test_op11(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_bpe.op11(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        ids = [*library.encode(r["text"]), 2]
        assert found[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


# -- tries ----------------------------------------------------------------------------------------------------------


def trie_nodes(rows, change):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}

    def sequence(c):
        h = zlib.crc32(str(c).encode()) % 6 if change else 0
        return tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])

    seqs = {c: sequence(c) for c in own}
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children.update(s[:-1] for s in members if s)
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(s))
        yield min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()


def check_trie(spark, rows, change=False, parts=5):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    found = [tuple(r) for r in prefix_trie.prefix_trie(made, change).collect()]
    assert Counter(found) == Counter(trie_nodes(rows, change))


def odd_turns(seed, convs):
    rng = np.random.default_rng(seed)
    rows = []
    for c in convs:
        for t in range(int(rng.choice([0, 1, 2, 3, 7, 30]))):
            rows.append((c, [t, t, None, 3][rng.integers(4)], ["a", "b", None][rng.integers(3)], ["x", "y", None, "", "long " * 900][rng.integers(5)]))
    return rows + rows[:20] + [(None, 1, "a", "x")]


def test_trie_on_odd_turns(spark):
    """Null turns, roles, texts and ids, equal turns, repeated rows, negative and large ids, with and without rebuilding."""
    rows = odd_turns(1, [*range(140), -5, -150, -100, 700, 2**40])
    check_trie(spark, rows)
    check_trie(spark, rows, change=True)


def test_trie_over_many_ranges(spark):
    """Paths of 20 turns that leave each other at every depth, many of them inside other ranges than their neighbours."""
    rows = [(c, d, "u", f"t{d}" if d < c % 23 else f"own {c % 7} {d}") for c in range(300) for d in range(c % 25)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        check_trie(spark, rows)
        check_trie(spark, rows, change=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_a_hot_conversation(spark, monkeypatch):
    """Many copies of one conversation beside others with its first turn: the members' digest is put together from pieces of several ranges."""
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(c, t, "u", "hello" if t == 0 else f"{t}" if c % 3 else f"{c} {t}") for c in range(2000) for t in range(3)]
    check_trie(spark, rows)


def test_trie_edges(spark):
    schema = "text string, conv_id long, role string, turn long, parent string, Shared string, key int"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    one = prefix_trie.prefix_trie(spark.createDataFrame([("x", 4, "r", 0, "p", "s", 1)], schema)).collect()
    assert [tuple(r)[:7] for r in sorted(one, key=lambda r: r["depth"])] == [(4, 0, None, 1, 1, 1, 0), (4, 1, 4, 1, 0, 1, 0)]
    ids = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    check_trie(spark, [(c, 0, "u", "x") for c in ids], change=True)  # no base, and nothing left of their own: the root alone


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=7), min_size=1, max_size=20, unique=True))
def test_patricia_in_one_range(words):
    """Edges of one range: as many nodes as prefixes, points only where the tree branches or a sequence ends."""
    items = [{"seq": "".join(c * prefix_trie.WIDTH for c in w), "tokens": [1] * len(w), "copies": 1, "conv_id": k, "ends": str(k)} for k, w in enumerate(sorted(words))]
    tree = prefix_trie.Patricia(0, 0, -1)
    tree.build(items)
    prefixes = {w[:d] for w in words for d in range(1, len(w) + 1)}
    assert sum(len(e[7]) for e in tree.edges) == len(prefixes)
    assert len(tree.edges) == sum(p in words or len({q[: len(p) + 1] for q in prefixes if len(q) > len(p) and q.startswith(p)}) > 1 for p in prefixes)
    assert tree.shared[0][6] == len(words) and tree.shared[0][8] == sum(not any(q != w and q.startswith(w) for q in words) for w in words)


# -- phrases --------------------------------------------------------------------------------------------------------


def best_phrases(rows, least=10, best=2000):
    n, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and f[q] >= least and 100 * f[q] >= 50 * a and (q[:2] == p or q[1:] == p) for q in f):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


def phrase_rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "reed", "stone", "É", "é", "x\x1cy", "a\x85", "zz", "q", "\xa0", "river", "don't", "\x00"]
    for _ in range(n):
        lang = [None, "und", "en", "en", "en", "d e"][rng.integers(6)]
        text = "".join(words[int(i)] + [" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", ";x "][rng.integers(9)] for i in rng.integers(0, len(words), int(rng.integers(0, 40))))
        yield lang, [text, text, text, None, ""][rng.integers(5)]


def test_collocations(spark, monkeypatch):
    """Small blocks, shards and runs, so that words, pairs and triples meet over all of them."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 600)
    monkeypatch.setattr(phrases, "CANDIDATES", 50)
    rows = [*phrase_rows(5, 400), *[("en", "one hot phrase " * 700)] * 2, ("en", "z" * 5000)]
    docs = spark.createDataFrame([(t, i, "x", 1, 2, g) for i, (g, t) in enumerate(rows)], "text string, id int, word string, first int, f int, lang string").repartition(5)
    for least, best in ((10, 2000), (3, 7)):
        assert sorted(map(tuple, phrases.collocations(docs, least=least, best=best).collect())) == sorted(best_phrases(rows, least, best))
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.filter("text IS NULL")).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 4 * 10**12, 5 * 10**12, 7 * 10**12 + 1
    found = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r")).first()[0]
    assert found == 1_000_000 * a * a // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300))
def test_bitmaps(row):
    """Shifts over the borders of machine words, runs of one word and gaps."""
    bitmaps = phrases.Bitmaps(np.array(row, np.uint32), 5)
    keys, counts = bitmaps.pairs()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter((a - 1) * 5 + b - 1 for a, b in zip(row, row[1:]) if a and b)
    triples, counts = bitmaps.triples(keys, np.ones(len(keys), bool)) if len(keys) else phrases._summed([])
    named = Counter({(int(keys[t // 5]) // 5 + 1, int(keys[t // 5]) % 5 + 1, t % 5 + 1): c for t, c in zip(triples.tolist(), counts.tolist(), strict=True)})
    assert named == Counter(t for t in zip(row, row[1:], row[2:]) if all(t))
