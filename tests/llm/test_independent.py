"""The learnt operators and the shuffle written out once more by loops, without any function of the modules they check."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

language = pytest.importorskip("scorewright.llm.language")
from scorewright.llm import quality, sharding  # noqa: E402

LABELLED = "/root/testdata/sf0.01"


def trained(texts):
    pieces = []
    for t in texts:
        data = t.encode()
        pieces += [data[i : i + 1024] for i in range(0, len(data), 1024) if len(data[i : i + 1024]) >= 8]
    size = min(65536, max(256, sum(map(len, pieces)) // 4))
    return zstandard.ZstdCompressionDict(zstandard.train_dictionary(size, pieces, level=3).as_bytes(), dict_type=zstandard.DICT_TYPE_FULLDICT)


def saved(text, good, bad):
    data = (text or "").encode()
    sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(data)) for d in (good, bad)]
    return (sizes[1] - sizes[0]) / (len(data) + 50)


def isotonic(x, y):
    """Pools of the nearest non-decreasing function by its max-min formula: (mean x, sum y, number) each."""
    order = sorted(range(len(x)), key=lambda i: x[i])
    total = np.concatenate([[0.0], np.cumsum([y[i] for i in order])])
    mean = (total[None, 1:] - total[:-1, None]) / np.maximum(np.arange(1, len(x) + 1)[None, :] - np.arange(len(x))[:, None], 1)
    fitted = [max(min(mean[j, k] for k in range(i, len(x))) for j in range(i + 1)) for i in range(len(x))]
    pools = defaultdict(list)
    for f, i in zip(fitted, order, strict=True):
        pools[round(f, 12)].append(i)
    return [(np.mean([x[i] for i in p]), sum(y[i] for i in p), len(p)) for _, p in sorted(pools.items())]


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="needs the labelled tables")
def test_quality_written_out(spark):
    """Dictionaries, differences, folds, pools and odds by plain calls; what README states of held-out rows of these tables."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet").collect() for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs}
    mark = {r["doc_id"]: r["quality"] for r in labels}
    teach = [d for d in sorted(mark) if zlib.crc32(str(d).encode()) % 5]
    sides = [list(dict.fromkeys(texts[d] for d in teach if mark[d] == q and 0 < len(texts[d]) <= 50_000)) for q in (1, 0)]
    share = sum(mark[d] for d in teach) / len(teach)
    x, y = [], []
    for fold in range(3):
        pair = [trained([t for k, t in enumerate(side) if k % 3 != fold]) for side in sides]
        for label, side in ((1, sides[0]), (0, sides[1])):
            for k, t in enumerate(side):
                if k % 3 == fold:
                    x.append(saved(t, *pair))
                    y.append(label)
    whole, steps = sum(y) / len(y), []
    for at, good, n in isotonic(x, y):
        p = (good + whole) / (n + 1)
        odds = p / (1 - p) * (share / (1 - share)) / (whole / (1 - whole))
        steps.append((at, odds / (1 + odds)))
    pair = [trained(side) for side in sides]
    found = {r["doc_id"]: r for r in quality.op3(spark, LABELLED).collect()}
    for d, text in texts.items():
        wanted = float(np.interp(saved(text, *pair), [a for a, _ in steps], [b for _, b in steps]))
        assert found[d]["score"] == pytest.approx(wanted, abs=1e-9) and found[d]["predicted"] == (wanted >= 0.3)
    held = [(found[d]["score"], q) for d, q in mark.items() if not zlib.crc32(str(d).encode()) % 5]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.92
    assert np.mean([s < 0.3 for s in bad]) >= 0.63 and np.mean([s >= 0.3 for s in good]) >= 0.99


def hashed_grams(text):
    """Hashes of all byte pairs and triples of the lower-cased text between two blanks, one at a time."""
    b, out = b" " + text.lower().encode() + b" ", []
    for order in (2, 3):
        for i in range(len(b) - order + 1):
            h = b[i] * 0x9E3779B1 % 2**32
            for c in b[i + 1 : i + order]:
                h = ((h ^ (h >> 15)) * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32
            out.append((h ^ (h >> 13)) * 0x27D4EB2F % 2**32 >> 16)
    return out


def test_language_written_out(spark, sf_dir):
    """Codewords, log-odds, calibration by another optimiser, losses and decoding of each document by loops."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in docs}
    taught = sorted({(t, g) for d, t, g in docs if not held[d] and t and g and len(t) <= 50_000})
    place = {(r["text"], r["lang"]): r["h"] for r in spark.createDataFrame(taught, "text string, lang string").select("text", "lang", F.xxhash64("text").alias("h")).collect()}
    taught.sort(key=lambda e: ((place[e] & ((1 << 52) - 1)) / float(1 << 52), *e))
    names = sorted({g for _, g in taught})
    bits = 2 ** (len(names) - 1) - 1
    code = [[1 if k == 0 or c >> (k - 1) & 1 else -1 for c in range(bits)] for k in range(len(names))]
    known = {t: Counter(hashed_grams(t)) for t, _ in taught} | {t: Counter(hashed_grams(t)) for _, t, _ in docs if t}
    counts = {g: Counter() for g in names}
    for k, (t, g) in enumerate(taught):
        if k % 4:
            counts[g] += known[t]
    rate = np.array([[(counts[g][h] + 0.05) for h in range(1 << 16)] for g in names])
    rate /= rate.sum(axis=1, keepdims=True)
    weights = []
    for b in range(bits):
        on, off = [[rate[k] for k in range(len(names)) if code[k][b] == s] for s in (1, -1)]
        weights.append(np.log(np.mean(on, axis=0)) - np.log(np.mean(off, axis=0)))

    def raw(text, b):
        return sum(n * weights[b][h] for h, n in known[text].items()) / sum(known[text].values())

    checks = [(t, names.index(g)) for k, (t, g) in enumerate(taught) if k % 4 == 0]
    slope, offset, trust = [], [], []
    for b in range(bits):
        x, y = np.array([raw(t, b) for t, _ in checks]), np.array([code[k][b] > 0 for _, k in checks], float)
        lo, w = None, np.zeros(2)
        for _ in range(200):  # Newton steps from zero, halved until the loss falls

            def loss(v):
                return np.logaddexp(0, -(2 * y - 1) * (v[0] * x + v[1])).sum() + 0.001 * (v @ v)

            p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
            grad = np.array([((p - y) * x).sum(), (p - y).sum()]) + 0.002 * w
            q = p * (1 - p)
            move = np.linalg.solve(np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 0.002 * np.eye(2), grad)
            while loss(w - move) > loss(w) and np.abs(move).max() > 1e-12:
                move = move / 2
            w = w - move
            if lo is not None and abs(lo - loss(w)) < 1e-13:
                break
            lo = loss(w)
        slope.append(w[0])
        offset.append(w[1])
        trust.append(1 / (1 + np.logaddexp(0, -(2 * y - 1) * (w[0] * x + w[1])).mean()))
    found = {r["doc_id"]: r for r in language.op6(spark, sf_dir).collect()}
    right = []
    for d, text, lang in docs:
        r = found[d]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        losses = [sum(trust[b] * math.log1p(math.exp(-code[k][b] * (slope[b] * raw(text, b) + offset[b]))) for b in range(bits)) for k in range(len(names))]
        odds = [math.exp(min(losses) - x) for x in losses]
        best = losses.index(min(losses))
        assert r["lang_pred"] == names[best] and r["score"] == pytest.approx(odds[best] / sum(odds), abs=2e-3)
        right += [r["lang_pred"] == lang] if held[d] else []
    assert np.mean(right) >= 0.98


def test_shuffle_written_out(spark, sf_dir):
    """Each row's place by one number at a time: six rounds over two halves, walking on while outside."""

    def mix(x, key):
        x ^= key
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    keys = [mix(20240229 * 64 + r, 0x9E3779B97F4A7C15) for r in range(6)]

    def place(row, n):
        half = 1
        while 4**half < n:
            half += 1
        while True:
            left, right = row >> half, row % 2**half
            for key in keys:
                left, right = right, left ^ (mix(right, key) % 2**half)
            row = left << half | right
            if row < n:
                return row

    found = sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.op10(spark, sf_dir).collect())
    assert [(s, t) for _, s, t in found] == [(place(k, len(found)) % 40, place(k, len(found)) // 40) for k in range(len(found))]
