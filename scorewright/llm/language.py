"""Language identification by error-correcting output codes.

Each language has a codeword. For every bit a binary classifier (log-odds of hashed byte n-grams, then a logistic
calibration) says whether a text's language has the bit. The loss of a codeword is the sum of the bits' logistic losses,
each weighted by how reliable its classifier was on texts it had not learnt; the nearest codeword wins, and
a text whose two nearest codewords are about equally near is flagged as ambiguous.

Learning is bounded: `per_language` distinct texts of each language, chosen by a hash, none of over `sample_chars` characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.common import id_remainder, keep_texts, row_slices
from scorewright.shipping import ship

HASH_BITS = 16
ORDERS = (2, 3)
PER_LANGUAGE = 400
SAMPLE_CHARS = 50_000
#: The code and the sample are made on the driver for this many languages at most; more raise an error.
MOST_LANGUAGES = 2000
#: A text is ambiguous if the best language's score exceeds the next one's by less.
AMBIGUITY = 0.05
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """+-1 codewords, a row each: all distinct columns up to 6 languages, else the best of some seeded random codes by least distance."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        return np.array([[1 if k == 0 or (c >> (k - 1)) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for k in range(n)])
    rng, bits = np.random.default_rng(11), int(np.ceil(10 * np.log2(n)))
    best = None
    for _ in range(20):
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min()
        if best is None or distance > best[0]:
            best = (distance, code)
    return best[1]


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased UTF-8 text between two blanks."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    parts, h = [], b * np.uint32(0x9E3779B1)
    for order in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + b[order - 1 :] * np.uint32(0xC2B2AE35)
        if order in ORDERS:
            parts.append((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(parts)


@dataclass
class LanguageModel:
    """weights: hashed n-gram by bit; slope, offset, trust: by bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def raw(self, text: str) -> np.ndarray:
        return self.weights[grams(text)].mean(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is ambiguous."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        margin = self.slope * self.raw(text) + self.offset
        loss = np.logaddexp(0, -self.code * margin) @ self.trust
        odds = np.exp(loss.min() - loss)
        order = np.argsort(-odds, kind="stable")
        share = odds / odds.sum()
        near = len(order) > 1 and share[order[0]] - share[order[1]] < AMBIGUITY
        return self.languages[order[0]], float(share[order[0]]), bool(near)


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Ties and order: languages are sorted, so equal losses go to the first by name."""
    names = sorted(set(languages))
    code = codewords(len(names)) if names else np.zeros((0, 1))
    which = np.array([names.index(x) for x in languages], np.int64)
    size, bits = 1 << HASH_BITS, code.shape[1]
    model = LanguageModel(names, code, np.zeros((size, bits), np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    if len(names) < 2:
        return model
    learns = np.arange(len(texts)) % 4 != 0  # the rest calibrates
    rates = np.zeros((len(names), size), np.float32)
    for k in range(len(names)):
        mine = [grams(t) for t, w, on in zip(texts, which, learns, strict=True) if w == k and on]
        if mine:
            rates[k] = np.bincount(np.concatenate(mine), minlength=size)
        rates[k] = (rates[k] + 0.05) / (rates[k].sum(dtype=np.float64) + 0.05 * size)
    for b in range(bits):
        on, off = ((side / side.sum()).astype(np.float32) @ rates for side in (code[:, b] > 0, code[:, b] < 0))
        model.weights[:, b] = np.log(on) - np.log(off)
    held = np.flatnonzero(~learns)
    if len(held) < 2:
        held = np.arange(len(texts))
    raw = np.array([model.raw(texts[i]) for i in held])
    for b in range(bits):
        y = (code[which[held], b] > 0).astype(float)
        a = np.stack([raw[:, b], np.ones(len(held))], axis=1)
        w = np.array([10.0, 0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a.T * (p * (1 - p))) @ a + 0.002 * np.eye(2)
            move = np.linalg.solve(hessian, a.T @ (p - y) + 0.002 * w)
            w -= move / max(1.0, np.abs(move).max() / 5)
        model.slope[b], model.offset[b] = w
        loss = np.logaddexp(0, -(2 * y - 1) * (a @ w)).mean()
        model.trust[b] = 1 / (1 + loss)
    return model


def learn(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """One count of the distinct texts by language, then one scan that keeps per_language texts of each (all, if it has fewer).

    Texts are taken in the order of a hash, so a run can be repeated; equal texts of a language are one example. Null and empty
    texts, null languages and texts of over sample_chars characters don't teach. At most per_language rows of MOST_LANGUAGES languages are collected."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.filter(teaches & lang.isNotNull() & text.isNotNull() & F.length(text).between(1, sample_chars)).select(text.alias("text"), lang.alias("lang"))
    # copies are taken or left together, so they count once; only hashes are shuffled
    counts = rows.select("lang", F.xxhash64("text").alias("hash")).groupBy("lang").agg(F.countDistinct("hash").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return fit([], [])
    # shares that hold per_language texts, but for odds of one in a billion
    wanted = per_language + 6 * per_language**0.5 + 20
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, wanted / r["n"])) for r in counts], "lang string, rate double")
    place = F.xxhash64("text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    # a row for each language, MOST_LANGUAGES at most
    sample = rows.withColumn("place", place).join(F.broadcast(rates), "lang").filter("place < rate").select("text", "lang", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    found = sorted((r["place"], r["text"], r["lang"]) for r in sample.withColumn("rank", rank).filter(F.col("rank") <= per_language).collect())
    return fit([t for _, t, _ in found], [lang for _, _, lang in found])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row.

    Null texts and texts without a letter: 'und', score 0, ambiguous. Null or repeated ids: a row each. Nothing learnt: 'und'.
    Texts of any length are read whole. Ties go to the first language by name. Empty table: no rows. Other columns, whatever
    their names, are ignored."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2^16 bytes a bit, bounded by MOST_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in row_slices(batches):
            names, scores, flags = zip(*map(model.predict, rows.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is told and isn't ambiguous. Nulls, ties and long texts as in predict(); no
    column is added, so names can't clash. Repeated rows are kept or dropped together. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], np.ndarray]:
        model = shared.value
        return lambda texts: np.array([not model.predict(t)[2] for t in texts], bool)

    return keep_texts(docs, text_col, make)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, learn(docs, id_remainder("doc_id", 3) != 1))
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
