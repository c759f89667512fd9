"""Products of many columns against numpy, and mean changes of busy entities against the lag."""

import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.operators import matrices, scorecard, sequence


def test_six_hundred_columns_in_one_scan(spark):
    n, p = 3000, 600
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, 12))
    columns = [(F.col("b")[k % 12] * float(1 + k) + F.col("b")[(k * 7 + 1) % 12] + 1e6 * (k % 3)).alias(f"c{k}") for k in range(p)]
    df = spark.createDataFrame([(r.tolist(),) for r in base], "b array<double>").repartition(4).select(columns)
    x = np.column_stack([base[:, k % 12] * (1 + k) + base[:, (k * 7 + 1) % 12] + 1e6 * (k % 3) for k in range(p)])
    began = time.perf_counter()
    found = {(r["x"], r["y"]): r["r"] for r in scorecard.correlations(df, df.columns).collect()}
    assert time.perf_counter() - began < 120 and len(found) == p * (p - 1) // 2
    r = np.corrcoef(x.T)
    assert max(abs(found[f"c{i}", f"c{j}"] - r[i, j]) for i, j in combinations(range(0, p, 7), 2)) < 1e-6
    assert scorecard.gram(df, df.columns) == pytest.approx(x.T @ x, rel=1e-9)


def test_pairs_with_gaps(spark):
    """Missing values pair by pair, a constant column, a column without values, pairs that no row has, several partitions."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) + 50
    x[rng.random((200, 5)) < 0.3] = np.nan
    x[:, 3] = 4.0
    x[:100, 0] = np.nan
    x[100:, 1] = np.nan
    rows = [[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)] + [None] for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, none double").repartition(3)
    found = {(r["x"], r["y"]): (r["n"], r["r"]) for r in matrices.pairwise(df, df.columns).collect()}
    for i, j in combinations(range(5), 2):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        n, r = found["abcde"[i], "abcde"[j]]
        assert n == both.sum()
        assert r is None if n < 2 or 3 in (i, j) else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    assert found["a", "b"] == (0, None) and found["e", "none"] == (0, None)
    whole = x[~np.isnan(x).any(axis=1)]
    assert matrices.complete_gram(df.select("a", "b", "c", "d", "e"), list("abcde")) == pytest.approx(whole.T @ whole)
    assert matrices.pairwise(df.limit(0), ["a", "b"]).collect() == [] and not matrices.complete_gram(df.limit(0), ["a", "b"]).any()


def test_states_merge_in_any_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) * 1e3 + 1e6
    x[rng.random((90, 4)) < 0.2] = np.nan
    parts = [matrices._state(x[a : a + 30]) for a in (0, 30, 60)]
    one = matrices.merge_states(matrices.merge_states(parts[0], parts[1]), parts[2])
    other = matrices.merge_states(parts[2], matrices.merge_states(parts[1], parts[0]))
    assert one == pytest.approx(matrices._state(x)) and other == pytest.approx(one)


def test_changes_of_a_busy_entity(spark):
    """One entity with a third of all rows, nulls, ties, null entities, descending order: as by the lag, and dealt over many ranges."""
    df = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1001 == 1, None).otherwise(F.col("id") % 50).alias("e"), (F.col("id") * 7919 % 9973).alias("t"), F.col("id"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 31 % 1000).alias("v"), (F.col("id") % 13).cast("double").alias("w"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for order in (["t", "id"], [F.desc("t"), F.col("id")]):
            found = {r["e"]: (r["change_v"], r["change_w"]) for r in sequence.average_changes(df, ["e"], order, ["v", "w"]).collect()}
            w = Window.partitionBy("e").orderBy(*order)
            lag = df.withColumns({c: F.col(c) - F.lag(c).over(w) for c in ("v", "w")}).groupBy("e").agg(F.avg("v").alias("v"), F.avg("w").alias("w"))
            wanted = {r["e"]: (r["v"], r["w"]) for r in lag.collect()}
            assert set(found) == set(wanted)
            for e in wanted:
                assert found[e] == pytest.approx(wanted[e])
        several = sequence.sequence_features(df, ["e"], ["t", "id"], [("v", "w")], [("v", "w")], ["v"])
        assert several.columns == ["e", "corr_v_w", "rega_v_w", "regb_v_w", "change_v"] and several.count() == len(wanted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lone = spark.createDataFrame([(1, 1, None), (2, 1, 5), (2, 2, None), (2, 3, 6)], "e long, t long, v long")
    assert {r["e"]: r["change_v"] for r in sequence.average_change(lone, ["e"], ["t"], "v").collect()} == {1: None, 2: None}
