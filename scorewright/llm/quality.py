"""Quality classifier by compression: one zstandard dictionary is trained on good labelled text, one on bad.

A text is compressed with either dictionary. The difference of the two compressed sizes over the text's length is the only
thing a score comes from; a monotone calibration (isotonic regression, linear between its steps) turns it into the share of
good texts among labelled ones with such a difference. The differences it learns from are taken with dictionaries that haven't
seen the text.

Learning is bounded: at most `per_class` labelled rows of each class, chosen by a hash of the id, none of over
`sample_chars` characters. Scoring is one map over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import id_remainder, keep_texts, row_slices
from scorewright.shipping import ship

LEVEL = 3
DICTIONARY_BYTES = 1 << 16
PIECE_BYTES = 1024
PER_CLASS = 2000
SAMPLE_CHARS = 50_000
THRESHOLD = 0.3
#: Parts of the labelled texts whose differences are taken with dictionaries from the other parts.
FOLDS = 3
#: Added to a text's length, so that the difference of a short text stays near the middle.
LENGTH_PRIOR = 50


@dataclass
class QualityModel:
    """Two dictionaries (bytes) and the calibration's steps: differences (ascending) and scores; under 200 KB whatever the data."""

    good: bytes
    bad: bytes
    steps: np.ndarray
    scores: np.ndarray

    def compressors(self) -> tuple:
        import zstandard

        made = []
        for data in (self.good, self.bad):
            entropy = data[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary's magic number; else its bytes are content
            kind = zstandard.DICT_TYPE_FULLDICT if entropy else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False))
        return tuple(made)

    def score(self, texts: list[str | None], compressors: tuple) -> np.ndarray:
        return np.interp([difference(t, compressors) for t in texts], self.steps, self.scores)


def difference(text: str | None, compressors: tuple) -> float:
    """Bytes that the good dictionary saves over the bad one, over the text's length in bytes."""
    data = (text or "").encode()
    good, bad = (len(c.compress(data)) for c in compressors)
    return (bad - good) / (len(data) + LENGTH_PRIOR)


def calibrate(differences: np.ndarray, good: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps and scores of the non-decreasing function nearest to the labels (pool adjacent violators), each pool drawn to the
    whole by one observation, its odds carried from the sample's share of good texts to `share` of all labels."""
    order = np.argsort(differences, kind="stable")
    pools: list[list[float]] = []  # sum of labels, number, sum of differences
    for x, y in zip(differences[order].tolist(), good[order].tolist(), strict=True):
        pools.append([y, 1, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    whole = float(good.mean())
    p = np.array([(y + whole) / (n + 1) for y, n, _ in pools])
    odds = p / (1 - p) * (share / (1 - share)) / (whole / (1 - whole))
    return np.array([x / n for _, n, x in pools]), odds / (1 + odds)


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or, from too little text to train one, the text itself."""
    import zstandard

    pieces = [d[i : i + PIECE_BYTES] for d in (t.encode() for t in texts) for i in range(0, len(d), PIECE_BYTES)]
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 4)), pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"\n".join(pieces) or b"empty text")[:DICTIONARY_BYTES].ljust(8, b"\n")


def fit(good: list[str], bad: list[str], share: float | None = None) -> QualityModel:
    """Dictionaries from all texts; the calibration from each text's difference under dictionaries from the other folds (from
    the final ones, if a class has fewer than 6 texts).

    `share` is the share of good texts to calibrate to, the sample's own if it isn't given. Without texts of a class the score is
    constant: `share`, or 0.5 without any text."""
    taken = len(good) / max(1, len(good) + len(bad)) if good or bad else 0.5
    share = taken if share is None else share
    model = QualityModel(dictionary(good), dictionary(bad), np.zeros(1), np.array([share]))
    if not good or not bad or not 0 < share < 1:
        return model
    folds = FOLDS if min(len(good), len(bad)) >= 6 else 1
    x, y = [], []
    for fold in range(folds):
        rest = [[t for k, t in enumerate(texts) if folds == 1 or k % folds != fold] for texts in (good, bad)]
        compressors = QualityModel(*map(dictionary, rest), model.steps, model.scores).compressors() if folds > 1 else model.compressors()
        for label, texts in ((1.0, good), (0.0, bad)):
            mine = [difference(t, compressors) for k, t in enumerate(texts) if k % folds == fold]
            x += mine
            y += [label] * len(mine)
    model.steps, model.scores = calibrate(np.array(x), np.array(y), share)
    return model


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> tuple[QualityModel, float]:
    """The model, and the share of good rows among all labelled rows that teach, to which its scores are calibrated.

    Ids are chosen from the labels alone, so no text is sorted. One text of each chosen id and label is collected (of a
    repeated id the least), so 2 * per_class texts at most; equal texts of a label are one example. Null ids, other labels than 0 and
    1, and null or empty texts don't teach. Without labels every score is 0.5."""
    known = labels.filter(teaches & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(chosen, "id").filter(F.length("text").between(1, sample_chars)).groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    by: dict[int, dict[str, None]] = {0: {}, 1: {}}
    for r in sorted(texts, key=lambda r: r["id"]):
        by[r["label"]][r["text"]] = None
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    return fit(list(by[1]), list(by[0]), share), share


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row.

    Null text: scored as the empty text. Null or repeated ids: a row each. Texts of any length are compressed whole. Ties: equal
    texts have equal scores. Empty table: no rows. Other columns, whatever their names, are ignored."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 200 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors()
        for rows in row_slices(batches):
            scores = model.score(rows.column(1).to_pylist(), compressors)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold. Nulls, ties and long texts as in score(); no column
    is added, so names can't clash. Repeated rows are kept or dropped together. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], np.ndarray]:
        model = shared.value
        compressors = model.compressors()
        return lambda texts: model.score(texts, compressors) >= threshold

    return keep_texts(docs, text_col, make)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, _ = learn(docs, labels, id_remainder("doc_id", 5) != 0)
    scored = score(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
