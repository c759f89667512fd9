"""Boosted trees against a plain version, row by row and node by node."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import boosting, models

CONFIGURED = {
    "n_estimators": 100, "max_depth": 5, "learning_rate": 0.1, "verbosity": 0, "objective": "binary:logistic", "booster": "gbtree", "tree_method": "exact", "n_jobs": -1, "gamma": 0,
    "min_child_weight": 1, "max_delta_step": 0, "subsample": 0.8, "colsample_bytree": 0.8, "colsample_bylevel": 0.8, "colsample_bynode": 0.8, "reg_alpha": 1, "reg_lambda": 1,
    "scale_pos_weight": 1, "base_score": 0.5, "random_state": 233, "missing": None, "num_parallel_tree": 1, "monotone_constraints": "()", "interaction_constraints": "", "importance_type": "gain",
}


def sample(n, seed=0):
    """Few distinct values, some missing, a column that decides by being missing, and one of nulls."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(-3, 4, n) / 2, rng.integers(0, 5, n)]).astype(float)
    x[rng.random(n) < 0.2, 1] = np.nan
    y = (x[:, 0] + np.where(np.isnan(x[:, 1]), 3, x[:, 1]) * 2 + rng.normal(0, 2, n) > 4).astype(float)
    return x, y


def frame(spark, x, y, extra=()):
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], None, float(t), *(e[k] for e in extra)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, none double, y double" + "".join(f", e{k} boolean" for k in range(len(extra)))).repartition(3)


def plain_margins(x, y, p, way=()):
    """Trees by trying every cut of every node on the values themselves."""
    margin = np.full(len(y), math.log(p["base_score"] / (1 - p["base_score"])) if p["logistic"] else p["base_score"])

    def soft(g):
        return math.copysign(max(abs(g) - p["alpha"], 0), g)

    def weight(g, h, low, high):
        return min(max(-soft(g) / (h + p["lambda"]), low), high)

    def score(g, h, w):
        return -(2 * g * w + (h + p["lambda"]) * w * w + 2 * p["alpha"] * abs(w))

    def grow(rows, depth, g, h, low, high):
        G, H = g[rows].sum(), h[rows].sum()
        w = weight(G, H, low, high)
        best = (1e-6, None)
        if depth < p["depth"]:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for t in sorted(set(v[~np.isnan(v)])):
                    for missing_left in (False, True):
                        left = np.where(np.isnan(v), missing_left, v <= t)
                        if missing_left and not np.isnan(v).any():
                            continue
                        a, b = rows[left], rows[~left]
                        if min(h[a].sum(), h[b].sum()) < max(p["least"], 1e-12):
                            continue
                        wl, wr = weight(g[a].sum(), h[a].sum(), low, high), weight(g[b].sum(), h[b].sum(), low, high)
                        if f < len(way) and way[f] * (wr - wl) < 0:
                            continue
                        gain = float(f"{score(g[a].sum(), h[a].sum(), wl) + score(g[b].sum(), h[b].sum(), wr) - score(G, H, w):.9g}")
                        if gain > best[0]:
                            best = (gain, a, b, f, wl, wr)
        if best[1] is None:
            return [(rows, w)], None
        gain, a, b, f, wl, wr = best
        sign, mid = (way[f] if f < len(way) else 0), (wl + wr) / 2
        one, cut1 = grow(a, depth + 1, g, h, mid if sign < 0 else low, mid if sign > 0 else high)
        two, cut2 = grow(b, depth + 1, g, h, mid if sign > 0 else low, mid if sign < 0 else high)
        if cut1 is None and cut2 is None and gain < p["gamma"]:
            return [(rows, w)], None
        return one + two, gain

    for _ in range(p["rounds"]):
        if p["logistic"]:
            chance = 1 / (1 + np.exp(-margin))
            g, h = chance - y, chance * (1 - chance)
            up = np.where(y == 1, p["pos"], 1.0)
            g, h = g * up, h * up
        else:
            g, h = margin - y, np.ones(len(y))
        for rows, w in grow(np.arange(len(y)), 0, g, h, -np.inf, np.inf)[0]:
            margin[rows] += p["rate"] * w
    return margin


@pytest.mark.parametrize(
    ("given", "way"),
    [({}, ()), ({"reg_alpha": 1.0, "gamma": 3.0, "scale_pos_weight": 2.0}, ()), ({"objective": "reg:squarederror", "min_child_weight": 7}, ()), ({"monotone_constraints": "(-1,1,0)"}, (-1, 1, 0))],
)
def test_equals_a_plain_version(spark, given, way):
    x, y = sample(240, 1)
    parameters = boosting.Parameters(**{"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, **given})
    model = boosting.fit(frame(spark, x, y), ["a", "b", "c", "none"], "y", parameters)
    found = {r["id"]: r["score"] for r in model.predict(frame(spark, x, y)).collect()}
    p = {"base_score": 0.5, "logistic": parameters.logistic, "alpha": parameters.reg_alpha, "lambda": 1.0, "gamma": parameters.gamma, "least": parameters.min_child_weight, "depth": 3, "rounds": 3, "rate": 0.3, "pos": parameters.scale_pos_weight}
    margin = plain_margins(x, y, p, way)
    wanted = 1 / (1 + np.exp(-margin)) if parameters.logistic else margin
    assert [found[k] for k in range(len(y))] == pytest.approx(wanted.tolist(), abs=1e-9)


def test_configured_parameters(spark, tmp_path):
    """All parameters of the file count; early stopping, samples, several trees a round, and the saved model."""
    x, y = sample(600, 2)
    df = frame(spark, x, y, [[k % 4 == 0 for k in range(600)]])
    zoo = models.ModelSet("classifier", {"XGBClassifier": {"model_para": CONFIGURED | {"n_estimators": 30, "max_depth": 2, "learning_rate": 0.5}, "fit_para": {"eval_metric": "auc", "early_stopping_rounds": 2}}})
    model = zoo.fit("XGBClassifier", df, ["a", "b", "c", "none"], "y", validation="e0")
    assert zoo.ignored == [] and len(model.history) < 30 and len(model.trees) == int(np.argmax(model.history)) + 1
    assert max(model.history) > 0.85
    again = boosting.fit(df.repartition(7), ["a", "b", "c", "none"], "y", model.p, validation="e0")
    assert json.loads(again.to_json())["trees"] and [t.cuts for t in again.trees] == [t.cuts for t in model.trees] and again.history == pytest.approx(model.history)
    zoo.save("XGBClassifier", str(tmp_path / "model"))
    before = {r["id"]: r["score"] for r in zoo.predict("XGBClassifier", df).collect()}
    zoo.load("XGBClassifier", str(tmp_path / "model"))
    assert before == {r["id"]: r["score"] for r in zoo.predict("XGBClassifier", df).collect()}
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["none"] == 0


def test_constraints_and_parallel_trees(spark):
    x, y = sample(300, 3)
    p = boosting.Parameters(n_estimators=2, max_depth=3, num_parallel_tree=2, subsample=0.5, interaction_constraints="[[0, 2], [1]]", max_delta_step=0.3, missing=8.0)
    model = boosting.fit(frame(spark, x, y), ["a", "b", "c"], "y", p)
    assert len(model.trees) == 4
    for t in model.trees:
        for k in t.cuts:
            path = {t.cuts[k][0]}
            while k:
                k = (k - 1) // 2
                path.add(t.cuts[k][0])
            assert path <= {0, 2} or path <= {1}
        assert all(abs(w) <= 0.3 * p.learning_rate / 2 + 1e-12 for w in t.leaves.values())
    assert all(8.0 not in e for e in model.edges)


def test_many_values_and_edges(spark):
    """More distinct values than bins are cut at quantiles; no rows, one class and unlabelled rows are no error."""
    df = spark.range(2000).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") % 10 == 9, None).otherwise(F.col("id") > 700).cast("double").alias("y"))
    model = boosting.fit(df, ["v"], "y", boosting.Parameters(n_estimators=3, max_bin=16))
    assert len(model.edges[0]) == 15 and [r["score"] > 0.5 for r in model.predict(df.filter("v IN (10, 1990)").sort("v")).collect()] == [False, True]
    empty = boosting.fit(df.limit(0), ["v"], "y", boosting.Parameters(n_estimators=1))
    assert [r["score"] for r in empty.predict(df.limit(1)).collect()] == [0.5]
    with pytest.raises(ValueError):
        boosting.Parameters(booster="dart")


def test_search(spark):
    x, y = sample(300, 4)
    zoo = models.ModelSet("classifier", {"XGBClassifier": {"model_para": {"n_estimators": 2}}})
    best = zoo.grid_search("XGBClassifier", frame(spark, x, y), ["a", "b"], "y", {"max_depth": [0, 2]}, folds=2)
    assert best.p.max_depth == 2
