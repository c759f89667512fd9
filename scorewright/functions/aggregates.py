"""The feature functions: each name maps to a Column builder and to its text in two SQL dialects.

``x`` is the conditional value, ``y`` the denominator's. Names are looked up without regard to case. Ratios are null where the
denominator is zero. STD and SKEW use the population deviation; SKEW keeps its damped denominator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F



@dataclass(frozen=True)
class FeatureFunction:
    """column(x, y) builds the aggregate; spark and duckdb are templates over {x} and {y}. distinct and share mark functions that are no
    partial sum: numbers of distinct values, and the value that `share` of all don't exceed. custom: an aggregate of functions/custom."""

    name: str
    column: Callable[[Column, Column], Column]
    spark: str
    duckdb: str
    ratio: bool = False
    distinct: bool = False
    share: float | None = None
    custom: object = None


def _skew(x: Column, _: Column) -> Column:
    mean, deviation = F.avg(x), F.stddev_pop(x)
    return (F.avg(F.pow(x, F.lit(3))) - 3 * mean * F.pow(deviation, F.lit(2)) - F.pow(mean, F.lit(3))) / (F.pow(deviation, F.lit(3)) + 0.01)


_SKEW = "(avg(pow({x}, 3)) - 3 * avg({x}) * pow(stddev_pop({x}), 2) - pow(avg({x}), 3)) / (pow(stddev_pop({x}), 3) + 0.01)"

#: Built-in functions by name.
REGISTRY: dict[str, FeatureFunction] = {}


def register(name: str, column: Callable, spark: str, duckdb: str | None = None, ratio: bool = False, distinct: bool = False, share: float | None = None, custom: object = None) -> None:
    """Add or replace a feature function for all later specs."""
    REGISTRY[name.upper()] = FeatureFunction(name.upper(), column, spark, duckdb or spark, ratio, distinct, share, custom)


register("SUM", lambda x, y: F.sum(x), "sum({x})")
register("AVG", lambda x, y: F.avg(x), "avg({x})")
register("MAX", lambda x, y: F.max(x), "max({x})")
register("MID", lambda x, y: F.percentile_approx(x, 0.5, 2147483647), "percentile_disc(0.5) within group (order by {x})", "quantile_disc({x}, 0.5)", share=0.5)
register("MIN", lambda x, y: F.min(x), "min({x})")
register("STD", lambda x, y: F.stddev_pop(x), "stddev_pop({x})")
register("COUNT", lambda x, y: F.count(x), "count({x})")
register("CNT", lambda x, y: F.count(x), "count({x})")
register("CNTDIST", lambda x, y: F.countDistinct(x), "count(distinct {x})", distinct=True)
register("SUMABS", lambda x, y: F.sum(F.abs(x)), "sum(abs({x}))")
register("MAXABS", lambda x, y: F.max(F.abs(x)), "max(abs({x}))")
register("MINABS", lambda x, y: F.min(F.abs(x)), "min(abs({x}))")
register("AVGABS", lambda x, y: F.avg(F.abs(x)), "avg(abs({x}))")
register("SKEW", _skew, _SKEW)
register("PCTSUM", lambda x, y: F.try_divide(F.sum(x), F.sum(y)), "try_divide(sum({x}), sum({y}))", "sum({x}) / nullif(sum({y}), 0)", ratio=True)
register("PCTCNT", lambda x, y: F.try_divide(F.count(x), F.count(y)), "try_divide(count({x}), count({y}))", "count({x}) / nullif(count({y}), 0)", ratio=True)
register(
    "PCTCNTDIST", lambda x, y: F.try_divide(F.countDistinct(x), F.countDistinct(y)),
    "try_divide(count(distinct {x}), count(distinct {y}))", "count(distinct {x}) / nullif(count(distinct {y}), 0)", ratio=True, distinct=True,
)


def lookup(name: str) -> FeatureFunction:
    if name.upper() not in REGISTRY:
        raise ValueError(f"unknown feature function {name}")
    return REGISTRY[name.upper()]


def register_sql(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """Make an Arrow-batched scalar function (pandas Series to Series) callable from SQL text."""
    spark.udf.register(name, F.pandas_udf(function, returns))
