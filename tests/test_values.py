"""Values worked out by hand or from the formulas."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright import jvm
from scorewright.functions.expressions import left_padded
from scorewright.operators import binning, evaluate, neural, profile, scorecard, text
from scorewright.operators.ranges import range_number
from scorewright.plans import features
from scorewright.plans.specs import FeatureSpec


def test_skew(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0)], "k int, x double")
    spec = [FeatureSpec("T", ("x",), ("skew",))]
    assert features.compute(df, spec, ["k"]).first()["T__SKEW__x"] == pytest.approx(0.3798439, abs=1e-6)


def test_chi2(spark):
    statistic, dof, p = binning.chi2_test(spark, [[20, 10], [5, 15]])
    assert (statistic, dof) == (pytest.approx(6.75), 1)
    assert p == pytest.approx(0.0093748, abs=1e-6)
    assert binning.chi2([[20, 10], [5, 15]], yates=False)[0] == pytest.approx(8.333333, abs=1e-6)
    assert jvm.chi2_isf(spark, 0.05, 1) == pytest.approx(3.8414588, abs=1e-6)
    with pytest.raises(ValueError):
        binning.chi2_test(spark, [[0, 0], [1, 2]])


def _pairs(spark, table):
    return spark.createDataFrame([(b, y) for b, (g, n) in table.items() for y in [1] * g + [0] * n], "bin string, y int")


def test_woe_iv(spark):
    df = _pairs(spark, {"A": (30, 10), "B": (20, 40)})
    found = {r["bin"]: r["woe"] for r in scorecard.woe(df, "bin", "y").collect()}
    assert found == {"A": pytest.approx(1.0360919, abs=1e-6), "B": pytest.approx(-0.6690496, abs=1e-6)}
    assert scorecard.information_value(df, "bin", "y").first()["iv"] == pytest.approx(0.6686830, abs=1e-6)


def test_psi_of_equal_tables_is_zero(spark):
    df = spark.range(200).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    assert all(r["psi"] == pytest.approx(0) for r in scorecard.psi(df, df, ["c"], ["x"]).collect())


def test_vif(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 3.0)], "x1 double, x2 double")
    assert [r["vif"] for r in scorecard.vif(df, ["x1", "x2"]).collect()] == [pytest.approx(5.5980861, abs=1e-6)] * 2
    assert scorecard.vif_filter(df.withColumn("x3", F.col("x1") * 2), ["x1", "x2", "x3"]) == ["x2", "x3"]


def test_t(spark):
    row = scorecard.t_test(spark.createDataFrame([(x,) for x in (5.1, 4.9, 5.6, 5.8, 6.0)], "x double"), "x", 5.0).first()
    assert (row["t"], row["dof"], row["diff"]) == (pytest.approx(2.3040737, abs=1e-6), 4, pytest.approx(0.48))
    assert scorecard.t_test_p(spark, 2.262, 9) == pytest.approx(0.05, abs=1e-3)


def test_curves(spark):
    df = spark.createDataFrame(list(zip([0.9, 0.8, 0.8, 0.4, 0.1], [1, 1, 0, 1, 0], strict=True)), "s double, y int")
    assert evaluate.auc(df, "s", "y").first()[0] == pytest.approx(0.75)
    assert evaluate.ks(df, "s", "y").first()[0] == pytest.approx(0.5)
    assert evaluate.max_f1(df, "s", "y").first()[0] == pytest.approx(0.8571429, abs=1e-6)


EMISSIONS, MOVES = np.array([[1, 0], [0, 2], [1.5, 0]]), np.array([[0.5, -0.5], [0, 0.2]])


def test_viterbi():
    assert neural.viterbi(EMISSIONS, MOVES) == (pytest.approx(4.0), [0, 1, 0])
    assert neural.log_partition(EMISSIONS, MOVES) == pytest.approx(5.0586108, abs=1e-6)
    assert neural.negative_log_likelihood(EMISSIONS, MOVES, [0, 1, 0]) == pytest.approx(1.0586108, abs=1e-6)


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 10**6))
def test_no_path_beats_viterbi(seed):
    rng = np.random.default_rng(seed)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    best, path = neural.viterbi(e, t)
    assert neural.path_score(e, t, path) == pytest.approx(best)
    assert all(neural.path_score(e, t, list(rng.integers(0, 3, 5))) <= best + 1e-9 for _ in range(20))
    assert neural.log_partition(e, t) >= best


def test_recurrent_shapes():
    rng = np.random.default_rng(1)

    def side(gates, inputs):
        return {"W": rng.normal(size=(gates * 4, inputs)), "U": rng.normal(size=(gates * 4, 4)), "b": np.zeros(gates * 4), "c": np.zeros(gates * 4)}

    for kind, gates in (("lstm", 4), ("gru", 3)):
        net = neural.Recurrent(kind, 4, [[side(gates, 5), side(gates, 5)], [side(gates, 8), side(gates, 8)]])
        x = rng.normal(size=(7, 5))
        assert net.forward(x).shape == (7, 8)
        assert np.allclose(net.forward(np.stack([x, x]))[1], net.forward(x))
    assert neural.attend(np.ones((1, 2)), np.eye(2), np.array([[1.0], [3.0]]))[0, 0] == pytest.approx(2.0)


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id int, n int")
    assert [r[0] for r in text.batches(df, "n", 3, ["id"]).orderBy("id").select("batch_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert {r[0] for r in text.batches(df, "n", 30, ["id"]).select("batch_id").collect()} == {0}
    row = spark.range(1).select(left_padded(F.array(F.lit(5), F.lit(6)), 4, 0).alias("a"), left_padded(F.array(*map(F.lit, range(1, 6))), 4, 0).alias("b")).first()
    assert (row["a"], row["b"]) == ([0, 0, 5, 6], [1, 2, 3, 4])


def test_early_stop():
    assert text.early_stop([0.1, 0.5, 0.5, 0.4, 0.4], 3)
    assert not text.early_stop([0.1, 0.5, 0.5, 0.6, 0.4], 3)
    assert not text.early_stop([0.5, 0.4], 3)


def test_chimerge(spark):
    df = spark.createDataFrame([(float(i), int(i >= 60)) for i in range(100)], "x double, y int")
    assert binning.chimerge(df, "x", "y", 2) == [pytest.approx(59.4, abs=1)]
    cats = spark.createDataFrame([(c, y) for c, g in (("a", 30), ("b", 29), ("c", 5), ("d", 2)) for y in [1] * g + [0] * (40 - g)], "c string, y int")
    found = dict(map(tuple, binning.chimerge_categories(cats, "c", "y", 2).collect()))
    assert found["a"] == found["b"] != found["c"] == found["d"]
    assert binning.chimerge_categories(spark.createDataFrame([], "c string, y int"), "c", "y").collect() == []
    rare = spark.createDataFrame([("a", 1)] * 40 + [("b", 0)] * 40 + [(f"r{k}", k % 2) for k in range(50)] + [(None, 1)] * 9, "c string, y int")
    found = dict(map(tuple, binning.chimerge_categories(rare, "c", "y", 3).collect()))
    assert len(found) == 52 and len({found[f"r{k}"] for k in range(50)}) == 1 and len(set(found.values())) == 3
    with pytest.raises(ValueError):
        binning.chimerge_categories(rare, "c", "y", 3, rare=1, most=51)


def _merged(counts, adjacent, bins, threshold):
    """All pairs looked at in every round."""
    groups = [[k] for k in range(len(counts))]
    counts = [list(c) for c in counts]
    while len(groups) > 2:
        pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, i + 2 if adjacent else len(groups)) if j < len(groups)]
        value, i, j = min((binning.chi2([counts[i], counts[j]])[0], i, j) for i, j in pairs)
        if len(groups) <= bins if bins else value >= threshold:
            break
        groups[i], counts[i] = groups[i] + groups.pop(j), [a + b for a, b in zip(counts[i], counts.pop(j), strict=True)]
    return groups


@pytest.mark.parametrize("adjacent", [True, False])
@pytest.mark.parametrize("classes", [1, 2, 3])
def test_merging_looks_at_all_pairs(adjacent, classes):
    rng = np.random.default_rng(classes)
    for bins, threshold in ((None, 3.84), (None, 1e9), (4, 0.0)):
        counts = rng.integers(0, 997, (30, classes)).astype(float).tolist()
        if adjacent:
            groups, start = [], 0
            for last in binning.merge_neighbours(np.array(counts), bins, threshold):
                groups.append(list(range(start, last + 1)))
                start = last + 1
        else:
            merging = binning._Merging([[k] for k in range(30)], [list(c) for c in counts])
            merging.run(bins, threshold)
            groups = merging.groups
        if classes > 1:
            assert groups == _merged(counts, adjacent, bins, threshold)
        assert sorted(k for g in groups for k in g) == list(range(30))


def test_merging_of_many_columns(spark):
    """200 columns without a job for each: the edges of each are those of the column alone; ties, nulls, and a column without values."""
    rng = np.random.default_rng(6)
    base = [([int(v) for v in rng.integers(0, 40, 5)], int(rng.random() < 0.4)) for _ in range(400)]
    columns = [((F.col("b")[k % 5] * (k + 1)) % (7 + k)).alias(f"c{k}") for k in range(200)]
    df = spark.createDataFrame(base, "b array<int>, y int").repartition(3).select("y", F.lit(None).cast("double").alias("none"), *columns)
    names = [f"c{k}" for k in range(200)] + ["none"]
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("merging", "merging")
    found = {r["col_name"]: r["cuts"] for r in binning.chimerge_columns(df, names, "y", 4).collect()}
    jobs = len(tracker.getJobIdsForGroup("merging"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert set(found) == set(names) and found["none"] == [] and jobs < 60
    rows = [r.asDict() for r in df.collect()]
    for c in names[:200:13]:
        cuts = binning.quantile_cuts(df, c, 100)
        counts = {}
        for r in rows:
            counts.setdefault(sum(e < r[c] for e in cuts), [0.0, 0.0])[r["y"]] += 1
        bins = sorted(counts)
        groups = _merged([counts[b] for b in bins], True, 4, 0.0)
        assert found[c] == pytest.approx([cuts[bins[g[-1]]] for g in groups[:-1]])


@pytest.mark.parametrize("values", [[], [2.5], [1.0, 2.0], [7.0] * 900 + list(range(300)), np.random.default_rng(2).normal(size=3000).tolist(), [0.0, -0.0, 1.0, 1.0]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    found, top = binning.quantiles(df, "x", shares)
    assert found == pytest.approx(list(np.quantile(values, shares)) if values else []) and top == max(values, default=None)


def test_quantiles_by_whole_numbers_and_texts(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(11)], "n long, t string")
    assert binning.quantiles(df, "n", [0.5]) == binning.quantiles(df, "t", [0.5]) == ([5.0], 10.0)


@pytest.mark.parametrize("size", [0, 1, 2, 5, 63, 200])
def test_range_numbers(spark, size):
    cuts = sorted({float(x) for x in np.random.default_rng(size).integers(0, 500, size)})
    points = [*cuts, -1.0, 501.0, *np.linspace(0, 500, 77).tolist()]
    rows = spark.createDataFrame([(p,) for p in points], "x double").select("x", range_number(F.col("x"), cuts).alias("k")).collect()
    assert all(r["k"] == sum(c < r["x"] for c in cuts) for r in rows)


def test_top_percent_of_one_hot_score(spark):
    """Two thirds of the rows have one score: only the tie column orders them."""
    rows = [(k, 5.0 if k % 3 else float(k % 7), int(k * k % 11 < 4)) for k in range(900)] + [(901, None, 1)]
    found = {r["pct"]: (r["n"], r["prec"]) for r in evaluate.top_percent(spark.createDataFrame(rows, "id int, s double, y int"), "s", "y", ["id"]).collect()}
    order = [y for _, _, y in sorted(rows[:-1], key=lambda r: (-r[1], r[0]))]
    assert {p: n for p, (n, _) in found.items()} == {p: p * 9 for p in range(1, 101)}
    assert all(found[p][1] == pytest.approx(sum(order[: p * 9]) / (p * 9)) for p in found)
    assert all(r["n"] == 0 and r["prec"] is None for r in evaluate.top_percent(spark.createDataFrame([], "id int, s double, y int"), "s", "y", ["id"]).collect())


@pytest.mark.parametrize("kind", ["lstm", "gru"])
def test_recurrent_step_by_step(kind):
    rng, n = np.random.default_rng(8), 3
    gates = n * (4 if kind == "lstm" else 3)
    w = {"W": rng.normal(size=(gates, 5)), "U": rng.normal(size=(gates, n)), "b": rng.normal(size=gates), "c": rng.normal(size=gates) * (kind == "gru")}
    x, h, c = rng.normal(size=(6, 5)), [0.0] * n, [0.0] * n

    def gate(row, k, squash=lambda v: 1 / (1 + np.exp(-v))):
        """Gate k of one unit: its part from the input, its part from the state."""
        at = row + k * n
        a, b = sum(w["W"][at, i] * step[i] for i in range(5)) + w["b"][at], sum(w["U"][at, i] * h[i] for i in range(n)) + w["c"][at]
        return squash(a + b) if squash else (a, b)

    out = []
    for step in x:
        new_h, new_c = [], []
        for u in range(n):
            if kind == "lstm":
                new_c.append(gate(u, 1) * c[u] + gate(u, 0) * gate(u, 2, np.tanh))
                new_h.append(gate(u, 3) * np.tanh(new_c[u]))
            else:
                a, b = gate(u, 2, None)
                new_h.append((1 - gate(u, 1)) * np.tanh(a + gate(u, 0) * b) + gate(u, 1) * h[u])
        h, c = new_h, new_c
        out.append(h)
    assert neural.Recurrent(kind, n, [[w]]).forward(x) == pytest.approx(np.array(out))


def test_corr_filter_keeps_one_of_a_pair(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 7).cast("double").alias("c"))
    assert scorecard.corr_filter(df, ["a", "b", "c"], 0.8, {"a": 0.3, "b": 0.3, "c": 0.1}) == ["a", "c"]


def test_profile_of_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None, " 1"), (float("nan"), None, None), (3.0, None, "2 ")], "a double, b string, c string")
    assert {r["col_name"]: round(r["missing_pct"], 3) for r in profile.missing_share(df).collect()} == {"b": 1.0, "a": 0.333, "c": 0.333}
    assert profile.const_filter(df, 1.0).columns == ["a", "c"]
    assert dict(profile.clean_types(df).dtypes) == {"a": "double", "b": "string", "c": "double"}
    assert [r["c"] for r in profile.merge_categories(df, "c", 2).orderBy("a").collect()].count(None) == 1


def test_feature_classes_of_odd_columns(spark):
    rows = [(0.0, "a", True, 1), (-0.0, None, None, 2), (float("nan"), "a", True, 3), (None, "b", False, 3)]
    schema = "x double, t string, flag boolean, n long"
    found = {r[0]: (r[1], r[2]) for r in profile.feature_classes(spark.createDataFrame(rows, schema), 3).collect()}
    assert found == {"x": (3, "cat"), "t": (3, "cat"), "flag": (3, "res"), "n": (3, "cat")}
    assert profile.feature_classes(spark.createDataFrame(rows, schema), 2, ["n", "t"]).filter("col_name = 'n'").first()[1:] == (3, "num")
    assert {r["n_distinct"] for r in profile.feature_classes(spark.createDataFrame([], schema), 3).collect()} == {0}
