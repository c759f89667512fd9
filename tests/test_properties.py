"""Properties that hold for any data, on seeded random frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import binning, evaluate, scorecard, text


@pytest.fixture(scope="module", params=[1, 2])
def frame(spark, request):
    rng = np.random.default_rng(request.param)
    x = rng.integers(0, 60, 500).astype(float)
    y = (rng.random(500) < x / 80).astype(int)
    return spark.createDataFrame([(i, float(a), int(b), f"c{int(a) % 4}") for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x double, y int, c string").cache()


def test_auc_ignores_the_scale_of_scores(frame):
    stretched = frame.withColumn("x", F.exp(F.col("x") / 10) - 5)
    assert evaluate.auc(frame, "x", "y").first()[0] == pytest.approx(evaluate.auc(stretched, "x", "y").first()[0])


def test_auc_equals_all_pairs(frame):
    rows = frame.select("x", "y").collect()
    pos, neg = [r["x"] for r in rows if r["y"] == 1], [r["x"] for r in rows if r["y"] == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert evaluate.auc(frame, "x", "y").first()[0] == pytest.approx(wins / len(pos) / len(neg))


def test_values_of_information_are_not_negative(frame):
    assert scorecard.information_value(frame, "c", "y").first()["iv"] >= 0


def test_merging_leaves_no_more_bins_than_asked(frame):
    sizes = [len(binning.chimerge(frame, "x", "y", n)) + 1 for n in (2, 4, 8)]
    assert sizes == sorted(sizes) and all(s <= n for s, n in zip(sizes, (2, 4, 8), strict=True))


def test_numbers_follow_the_order(frame):
    numbered = text.number_rows(frame, "id", "n").orderBy("id").select("n").collect()
    assert [r["n"] for r in numbered] == list(range(500))


def test_batches_hold_all_rows(frame):
    sizes = [r["count"] for r in text.batches(frame, "x", 64, ["id"]).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sum(sizes) == 500 and sizes[:-1] == [64] * (len(sizes) - 1) and 64 <= sizes[-1] < 128


def test_split_is_stable_and_complete(frame):
    train, test = text.split(frame, "id")
    assert train.count() + test.count() == 500 and 0.6 < train.count() / 500 < 0.8
    assert {r["id"] for r in train.collect()} == {r["id"] for r in text.split(frame.repartition(7), "id")[0].collect()}
