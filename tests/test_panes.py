"""Windows put together from panes against the aggregation over all rows."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators.sequence import window_columns
from scorewright.plans import features
from scorewright.plans.panes import Panes
from scorewright.plans.specs import FeatureSpec, TableSpec

TABLE = TableSpec.from_dict({"database": "d", "table": ("flow", ""), "entitys": [("user", "bigint", "")], "dimensions": [("kind", "string", ""), ("value", "double", ""), ("code", "string", "")], "winpos_col": [("days", "int", "")], "win_nm": ["w1", "w2"]})
DAYS = ("days", [("COL<=7", "week", "d7"), ("COL>7 and COL<=20", "before", "d20"), ("COL<=400", "all", "all")])
KIND = ("kind", [("COL='a'", "a", "a"), ("COL<>'a'", "others", "o")])
SPECS = [
    FeatureSpec.from_dict({"tag": "V", "objects": ["value"], "function": ["SUM", "AVG", "MAX", "MIN", "STD", "COUNT", "CNT", "SUMABS", "MAXABS", "MINABS", "AVGABS", "SKEW", "PCTSUM_DAYS", "PCTCNT_KIND"], "condition_cols": [DAYS, KIND]}),
    FeatureSpec.from_dict({"tag": "C", "objects": ["code", "kind"], "function": ["CNTDIST", "PCTCNTDIST_DAYS", "PCTCNTDIST_KIND"], "condition_cols": [DAYS, KIND]}),
]
ASOF = {"w1": "2024-03-01", "w2": "2024-02-20"}


def rows(spark, first, last):
    """Nulls in values, codes, kinds and users; days of many and of no rows; a value that comes again on a later day."""
    days = spark.range(first, last).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), (F.col("id") * 7 % 9).cast("int"))).alias("k"))
    h = F.xxhash64("n", "k")
    return days.select(
        F.when(h % 17 == 0, None).otherwise(F.pmod(h, F.lit(5))).alias("user"), F.date_add(F.lit("2024-01-10").cast("date"), F.col("n").cast("int")).alias("at"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.pmod(h, F.lit(3)) + 1).cast("int")).alias("kind"),
        F.when(h % 7 == 0, None).otherwise((h % 1000) / 8.0).alias("value"), F.when(h % 5 == 0, None).otherwise(F.concat(F.lit("c"), F.pmod(h, F.lit(11)))).alias("code"),
    )


def check(panes, df):
    asof = {w: F.lit(d).cast("date") for w, d in ASOF.items()}
    found = {(r["user"], r["window"]): r.asDict() for r in panes.compute(asof).collect()}
    wide = window_columns(df, ["days"], F.col("at"), asof)
    for w in ASOF:
        wanted = features.compute(wide, SPECS, ["user"], TABLE, w).collect()
        assert {(r["user"], w) for r in wanted} == {k for k in found if k[1] == w}
        for r in wanted:
            mine = found[r["user"], w]
            for alias, value in r.asDict().items():
                got = mine[alias]
                assert got is None if value is None else got == (pytest.approx(value, rel=1e-9, abs=1e-6) if isinstance(value, float) else value), (alias, w, r["user"])


def test_equals_the_aggregation_over_rows(spark, tmp_path):
    panes = Panes(spark, str(tmp_path / "panes"), SPECS, ["user"], TABLE, "at")
    panes.append(rows(spark, 0, 40))
    check(panes, rows(spark, 0, 40))
    # a later day touches its own folder only, and a day that comes again replaces its panes
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "panes" / "sums").rglob("*.parquet")}
    panes.append(rows(spark, 40, 42))
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    check(panes, rows(spark, 0, 42))
    panes.append(rows(spark, 41, 42))
    check(panes, rows(spark, 0, 42))


def test_medians_are_refused(spark):
    spec = FeatureSpec.from_dict({"tag": "M", "objects": ["value"], "function": ["MID"]})
    with pytest.raises(ValueError):
        Panes(spark, "unused", [spec], ["user"], TABLE, "at")
