"""Tail probabilities against closed forms and the JVM's, and tests of many columns in one aggregation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright import jvm
from scorewright.functions import statistics
from scorewright.operators import binning, scorecard
from scorewright.plans import lineage


def test_tails(spark):
    rows = [(x, d) for x in (0.0, 1e-9, 0.3, 1.0, 2.5, 10.0, 77.0, 900.0) for d in (1, 2, 3, 10, 99, 1000)]
    df = spark.createDataFrame([*rows, (None, 3), (1.0, None), (1.0, 0)], "x double, d int")
    found = df.select("x", "d", statistics.chi2_p(F.col("x"), F.col("d")).alias("c"), statistics.t_two_sided_p(-F.col("x"), F.col("d")).alias("t")).collect()
    assert all(r["c"] is None and r["t"] is None for r in found if r["x"] is None or not r["d"])
    for r in found:
        if r["x"] is None or not r["d"]:
            continue
        assert r["c"] == pytest.approx(jvm.chi2_p(spark, r["x"], r["d"]), abs=1e-12)
        assert r["t"] == pytest.approx(jvm.t_two_sided_p(spark, r["x"], r["d"]), abs=1e-9)
        if r["d"] == 2:
            assert r["c"] == pytest.approx(math.exp(-r["x"] / 2), rel=1e-10)
        if r["d"] == 1:
            assert r["c"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), rel=1e-9)
            assert r["t"] == pytest.approx(1 - 2 / math.pi * math.atan(r["x"]), abs=1e-12)


def test_many_columns(spark):
    """Empty cells, nulls, one class only, two by two with the correction; groups of t-tests, a constant column."""
    rng = np.random.default_rng(8)
    rows = [("ab"[int(rng.integers(2))], "xyz"[int(rng.integers(3))] if k % 9 else None, "one", "pq"[k % 2], float(rng.normal()), 5.0) for k in range(300)]
    df = spark.createDataFrame(rows, "y string, c string, lone string, two string, v double, same double").repartition(3)
    found = {r["col_name"]: r for r in scorecard.chi2_tests(df, ["c", "lone", "two"], "y").collect()}
    for k, name in ((1, "c"), (3, "two")):
        table = [[float(sum(r[k] == v and r[0] == y for r in rows)) for y in "ab"] for v in sorted({r[k] for r in rows} - {None})]
        statistic, dof = binning.chi2(table)
        assert (found[name]["chi2"], found[name]["dof"]) == (pytest.approx(statistic), dof)
        assert found[name]["p"] == pytest.approx(jvm.chi2_p(spark, statistic, dof))
    assert found["lone"]["dof"] == 0 and found["lone"]["p"] is None
    tests = {(r["two"], r["col_name"]): r for r in scorecard.t_tests(df, ["v", "same"], 0.1, ["two"]).collect()}
    x = np.array([r[4] for r in rows if r[3] == "p"])
    t = (x.mean() - 0.1) / (x.std(ddof=1) / np.sqrt(len(x)))
    assert tests["p", "v"]["t"] == pytest.approx(t) and tests["p", "v"]["p"] == pytest.approx(jvm.t_two_sided_p(spark, t, len(x) - 1))
    assert tests["p", "same"]["t"] is None and tests["p", "same"]["p"] is None


def test_unread_statements(spark):
    script = "create table a as select * from b; this is no statement; create table c as select * from a"
    unread = []
    assert sorted(map(tuple, lineage.edges(spark, script, unread).collect())) == [("a", "c"), ("b", "a")] and unread == ["this is no statement"]
    with pytest.raises(Exception, match="PARSE|syntax"):
        lineage.edges(spark, script)
