"""A user's own aggregate in a spec and in SQL text, and a table function with PARTITION BY."""

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import aggregates, custom
from scorewright.plans import features, sqlgen
from scorewright.plans.specs import FeatureSpec


def log_mean():
    """exp(mean(ln(1 + x))) - 1: a state of two numbers."""
    return custom.Aggregate(
        lambda: (0, 0.0), lambda s, x: (s[0] + len(x), s[1] + float(np.log1p(x.astype(float)).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.expm1(s[1] / s[0])) if s[0] else None
    )


@pytest.fixture
def registered(spark):
    custom.register_aggregate(spark, "LOGMEAN", log_mean())
    yield
    aggregates.REGISTRY.pop("LOGMEAN")


SPEC = FeatureSpec.from_dict({"tag": "G", "objects": ["v"], "function": ["LOGMEAN", "COUNT"], "condition_cols": [("k", [("COL=0", "zero", "z"), ("COL>=0", "all", "all"), ("COL=9", "none", "no")])]})


def test_aggregate_in_specs_and_sql(spark, registered):
    """A hot entity in many partitions, null entities and values, an entity without values, a condition that no row meets."""
    rows = [((7 if k % 3 else None) if k % 5 else k % 4, f"c{k % 2}", None if k % 11 == 0 else float(k % 97), k % 3) for k in range(4000)] + [(50, "c0", None, 0)]
    df = spark.createDataFrame(rows, "e long, c string, v double, k int").repartition(6)
    found = {(r["e"], r["c"]): r for r in features.compute(df, [SPEC], ["e", "c"]).collect()}
    for key in {r[:2] for r in rows}:
        for name, test in (("z", lambda k: k == 0), ("all", lambda k: True), ("no", lambda k: False)):
            mine = [r[2] for r in rows if r[:2] == key and r[2] is not None and test(r[3])]
            got = found[key][f"G__LOGMEAN__v__{name}"]
            assert got is None if not mine else got == pytest.approx(np.expm1(np.log1p(mine).mean()))
            assert found[key][f"G__COUNT__v__{name}"] == len(mine)
    df.createOrReplaceTempView("own_rows")
    text, _ = sqlgen.feature_sql([replace(SPEC, function=("LOGMEAN",))], ["e", "c"], "own_rows")
    by_sql = {(r["e"], r["c"]): r["G__LOGMEAN__v__all"] for r in spark.sql(text).collect()}
    assert by_sql == {k: pytest.approx(r["G__LOGMEAN__v__all"]) if r["G__LOGMEAN__v__all"] is not None else None for k, r in found.items()}
    assert features.compute(df.limit(0), [SPEC], ["e", "c"]).collect() == []


def test_only_states_are_shuffled(spark):
    """One state for each Arrow batch and entity reaches the second level, whatever the rows."""
    df = spark.range(0, 30_000, 1, 3).select(F.lit(1).alias("e"), F.col("id").cast("double").alias("v"))
    sizes = custom.Aggregate(lambda: [], lambda s, x: [*s, len(x)], lambda a, b: a + b, lambda s: s, "array<long>")
    (found,) = custom.aggregate(df, ["e"], "v", ["1=1"], sizes).collect()
    assert sum(found["__v0"]) == 30_000 and len(found["__v0"]) <= 6


def test_table_function(spark):
    custom.register_table_function(spark, "sessions", custom.Sessions, "user long, number int, began double, ended double, events long")
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 6)), float(rng.integers(0, 40_000)) if k % 9 else None) for k in range(300)]
    spark.createDataFrame(rows, "user long, at double").repartition(4).createOrReplaceTempView("clicks")
    found = spark.sql("SELECT * FROM sessions(TABLE(SELECT user, at FROM clicks) PARTITION BY user ORDER BY at)").collect()
    wanted = []
    for user in range(6):
        times, cuts = sorted(t for u, t in rows if u == user and t is not None), []
        for t in times:
            if not cuts or t - cuts[-1][-1] > 1800:
                cuts.append([])
            cuts[-1].append(t)
        wanted += [(user, k, c[0], c[-1], len(c)) for k, c in enumerate(cuts)]
    assert Counter(map(tuple, found)) == Counter(wanted)
