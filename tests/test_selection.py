"""Exact order statistics of columns and of groups against sorting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.operators import selection
from scorewright.plans import features
from scorewright.plans.specs import FeatureSpec


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_bits_keep_the_order(values):
    x = np.array(values)
    bits = selection.ordered_bits(x)
    assert all((a < b) == (x[i] < x[j]) for i, a in enumerate(bits[:20]) for j, b in enumerate(bits[:20]))
    assert [selection.from_bits(b) for b in bits] == values


@pytest.mark.parametrize("few", [0, 100_000])
def test_quantiles_of_columns_by_group(spark, monkeypatch, few):
    """Null, NaN, infinite and equal values, a null group, a column without values; with and without the short last round."""
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][k % 3], float(rng.normal()) * 10.0 ** int(rng.integers(-5, 6)), [None, float("nan"), -0.0, 7.5, float("-inf")][k % 5], None, int(rng.integers(-3, 3))) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, odd double, none double, n int").repartition(3)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.75, 1.0]
    found = selection.column_quantiles(df, ["x", "odd", "none", "n"], shares, by="g")
    for g in ("a", "b", None):
        for k, c in ((1, "x"), (4, "n")):
            assert found[g, c] == pytest.approx(np.quantile([r[k] for r in rows if r[0] == g], shares), rel=1e-12)
        odd = sorted(r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2])
        assert found[g, "odd"][0] == odd[0] and found[g, "odd"][-1] == odd[-1] and (g, "none") not in found
    assert selection.column_quantiles(df.limit(0), ["x"], [0.5]) == {}


def test_median_of_a_hot_entity(spark):
    """Five million values of one entity beside small ones, many partitions: the median is that of the sorted values."""
    n = 5_000_000
    hot = spark.range(0, n, 1, 8).select(F.lit(1).cast("long").alias("e"), (F.col("id") * 48271 % 4_999_999).alias("v"), (F.col("id") % 3).alias("kind"))
    cold = spark.createDataFrame([(None, 5, 0), (None, 9, 0), (None, 7, 1), (2, None, 0), (3, 4, 2), (3, 4, 2), (3, 1, 0)], "e long, v long, kind long")
    spec = FeatureSpec.from_dict({"tag": "T", "objects": ["v"], "function": ["MID", "COUNT", "CNTDIST"], "condition_cols": [("kind", [("COL>=0", "all", "all"), ("COL=0", "first", "first")])]})
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = {r["e"]: r for r in features.compute(hot.unionByName(cold), [spec], ["e"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    values = np.arange(n) * 48271 % 4_999_999
    assert found[1]["T__MID__v__all"] == np.sort(values)[-(-n // 2) - 1]
    some = np.sort(values[::3])
    assert found[1]["T__MID__v__first"] == some[-(-len(some) // 2) - 1]
    assert [found[e]["T__MID__v__all"] for e in (None, 2, 3)] == [7, None, 4]
    assert [found[e]["T__MID__v__first"] for e in (None, 2, 3)] == [5, None, 1]
    assert found[1]["T__COUNT__v__all"] == n and found[1]["T__CNTDIST__v__all"] == 4_999_999
