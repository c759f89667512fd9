"""Scorecard statistics: WOE, IV, PSI, VIF, correlation filter, t-test."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright import jvm
from scorewright.functions import statistics
from scorewright.functions.expressions import edges, right_closed_bin
from scorewright.operators.binning import RARE, all_quantile_cuts, bin_counts
from scorewright.operators.matrices import complete_gram, pairwise
from scorewright.operators.profile import merge_categories
from scorewright.shipping import ship


def _by_bin(df: DataFrame, col: str, target: str, positive) -> DataFrame:
    good = F.col(target) == F.lit(positive)
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("bin")).agg(F.count_if(good).alias("g"), F.count_if(~good).alias("b"))


def woe(df: DataFrame, col: str, target: str, positive=1) -> DataFrame:
    """bin, woe = ln(((g + 1) / (b + 1)) / (G / B)); the totals aren't smoothed."""
    counts = _by_bin(df, col, target, positive)
    totals = counts.agg(F.sum("g").alias("g_all"), F.sum("b").alias("b_all"))  # one row
    ratio = ((F.col("g") + 1) / (F.col("b") + 1)) / F.try_divide(F.col("g_all").cast("double"), F.col("b_all"))
    return counts.crossJoin(F.broadcast(totals)).select("bin", F.ln(ratio).alias("woe"))


def woe_encode(df: DataFrame, col: str, target: str, positive=1, out: str | None = None) -> DataFrame:
    table = woe(df, col, target, positive).withColumnRenamed("bin", "__bin")
    return df.join(table, F.col(col) == F.col("__bin"), "left").withColumn(out or f"{col}_woe", F.col("woe")).drop("__bin", "woe")


def information_value(df: DataFrame, col: str, target: str, positive=1, rare: int = RARE) -> DataFrame:
    """One row: col_name, iv. Rare values are merged first; bins' counts and totals are raised by 1."""
    counts = _by_bin(merge_categories(df.select(col, target), col, rare), col, target, positive)
    totals = counts.agg((F.sum("g") + 1).alias("ga"), (F.sum("b") + 1).alias("ba"))  # one row
    g, b, ga, ba = (F.col("g") + 1).cast("double"), (F.col("b") + 1).cast("double"), F.col("ga"), F.col("ba")
    part = (b / ba - g / ga) * F.ln((b / g) / (ba.cast("double") / ga))
    return counts.crossJoin(F.broadcast(totals)).agg(F.sum(part).alias("iv")).select(F.lit(col).alias("col_name"), "iv")


def psi(train: DataFrame, test: DataFrame, categories: list[str], numbers: list[str], rare: int = RARE) -> DataFrame:
    """col_name, psi over all columns in one aggregation of each side.

    Numbers are cut at the training deciles; categories' rare values are merged on either side by its own counts. Rates are
    (n + 1) / sum(n) of bins that either side has."""
    cuts = all_quantile_cuts(train, numbers, 10)

    def side(df: DataFrame, name: str) -> DataFrame:
        df = reduce(lambda d, c: merge_categories(d, c, rare), categories, df.select(*categories, *numbers))
        binned = [right_closed_bin(F.col(c).cast("double"), edges(cuts[c])).cast("string").alias(c) for c in numbers]
        long = df.select(*[F.col(c).cast("string").alias(c) for c in categories], *binned).unpivot([], [*categories, *numbers], "col_name", "bin")
        return long.filter(F.col("bin").isNotNull()).groupBy("col_name", "bin").agg(F.count("*").alias(name))

    joined = side(train, "a").join(side(test, "b"), ["col_name", "bin"], "full_outer").na.fill(0, ["a", "b"])
    total = Window.partitionBy("col_name")
    p, q = ((F.col(x) + 1) / F.sum(x).over(total) for x in ("a", "b"))
    return joined.select("col_name", ((p - q) * F.ln(p / q)).alias("part")).groupBy("col_name").agg(F.sum("part").alias("psi"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Uncentred sums of products of all pairs, in one scan; rows with a missing value are left out."""
    return complete_gram(df, columns)


def vif_of(matrix: np.ndarray) -> np.ndarray:
    """Inflation factors without an intercept: G_ii times the inverse's; infinite where columns are dependent."""
    if np.linalg.matrix_rank(matrix, hermitian=True) < len(matrix):
        return np.full(len(matrix), np.inf)
    return np.diag(matrix) * np.diag(np.linalg.inv(matrix))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    values = vif_of(gram(df, columns))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "col_name string, vif double")


def vif_filter(df: DataFrame, columns: list[str], threshold: float = 10.0) -> list[str]:
    """Columns left after dropping the one of the largest factor until none exceeds the threshold; one scan in all."""
    matrix, left = gram(df, columns), list(range(len(columns)))
    while len(left) > 1:
        values = vif_of(matrix[np.ix_(left, left)])
        if values.max() <= threshold:
            break
        del left[int(values.argmax())]
    return [columns[i] for i in left]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r of all pairs x before y, pairwise complete, in one scan; null where a side is constant or no row has both."""
    return pairwise(df, columns).select("x", "y", "r")


def corr_filter(df: DataFrame, columns: list[str], threshold: float, iv: dict[str, float]) -> list[str]:
    """Columns left after removing the less informative one of correlated pairs.

    First, of pairs whose other member is coupled with nothing else, the one of lower value goes (equal: the later column); then the
    less valuable of the most correlated pair, until no correlation reaches the threshold. The matrix is computed once."""
    strength = {(r["x"], r["y"]): abs(r["r"] or 0.0) for r in correlations(df, columns).collect()}

    def r(a: str, b: str) -> float:
        return strength.get((a, b), strength.get((b, a), 0.0))

    def weaker(a: str, b: str) -> str:
        return a if iv[a] < iv[b] else b

    coupled = {c: {d for d in columns if d != c and r(c, d) >= threshold} for c in columns}
    gone: set[str] = set()
    for a, b in combinations(columns, 2):
        if b in coupled[a] and not gone & {a, b}:
            loser = weaker(a, b)
            if len(coupled[a if loser == b else b]) == 1:
                gone.add(loser)
    left = [c for c in columns if c not in gone]
    while len(left) > 1:
        a, b = max(combinations(left, 2), key=lambda p: r(*p))
        if r(a, b) < threshold:
            break
        left.remove(weaker(a, b))
    return left


def t_test(df: DataFrame, col: str, mean: float) -> DataFrame:
    """One row: n, t, dof, diff, std of a one-sample t-test; t is null for a constant sample."""
    x = F.col(col).cast("double")
    n, average, deviation = F.count(x), F.avg(x), F.stddev_samp(x)
    return df.agg(n.alias("n"), F.try_divide(average - mean, F.try_divide(deviation, F.sqrt(n))).alias("t"), (n - 1).alias("dof"), (average - mean).alias("diff"), deviation.alias("std"))


def t_tests(df: DataFrame, columns: list[str], mean: float, by: list[str] = ()) -> DataFrame:
    """col_name, n, t, dof, p of two-sided one-sample t-tests of many columns, for each group of `by`, in one aggregation."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), columns, "col_name", "x")
    n, average, deviation = F.count("x"), F.avg("x"), F.stddev_samp("x")
    found = long.groupBy(*by, "col_name").agg(n.alias("n"), F.try_divide(average - mean, F.try_divide(deviation, F.sqrt(n))).alias("t"), (n - 1).alias("dof"))
    ship(df.sparkSession)
    return found.withColumn("p", statistics.t_two_sided_p(F.col("t"), F.col("dof")))


def chi2_tests(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """col_name, chi2, dof, p of each category column against the target, from one aggregation of all columns; null values take no part.

    Sums over the cells that have rows give the statistic; a 2x2 table, whose gaps are alike in all cells, carries Yates' correction."""
    ship(df.sparkSession)
    long = df.select(F.col(target).cast("string").alias("t"), *[F.col(c).cast("string").alias(c) for c in columns]).filter("t IS NOT NULL").unpivot(["t"], columns, "col_name", "v").filter("v IS NOT NULL")
    cells = long.groupBy("col_name", "v", "t").agg(F.count("*").cast("double").alias("n"))
    rows, cols, every = (Window.partitionBy("col_name", *more) for more in (["v"], ["t"], []))
    placed = cells.withColumns({"row": F.sum("n").over(rows), "col": F.sum("n").over(cols), "all": F.sum("n").over(every)})
    total, n = F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("col") / F.col("all"))), F.max("all")
    found = placed.groupBy("col_name").agg(
        F.greatest(total - n, F.lit(0.0)).alias("raw"), ((F.countDistinct("v") - 1) * (F.countDistinct("t") - 1)).cast("int").alias("dof"),
        (n * F.sum(F.col("n") / (F.col("row") * F.col("row"))) * F.sum(F.col("n") / (F.col("col") * F.col("col")))).alias("shares"),
    )
    gap = F.sqrt(F.col("raw") / F.col("shares"))
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) * F.col("shares")
    found = found.select("col_name", F.when(F.col("dof") == 1, corrected).otherwise(F.col("raw")).alias("chi2"), "dof")
    return found.withColumn("p", statistics.chi2_p(F.col("chi2"), F.col("dof")))


def information_values(df: DataFrame, columns: list[str], target: str, bins: int = 10, positive=1) -> DataFrame:
    """col_name, iv of many columns of numbers, cut into quantile bins, in a fixed number of jobs. Bins' counts and totals are raised by 1."""
    cuts = all_quantile_cuts(df, columns, bins)
    good = F.col("target") == F.lit(positive)
    counts = bin_counts(df, cuts, target).groupBy("col_name", "bin").agg(F.sum(F.when(good, F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(~good, F.col("n")).otherwise(0)).alias("b"))
    every = Window.partitionBy("col_name")
    placed = counts.withColumns({"ga": F.sum("g").over(every) + 1, "ba": F.sum("b").over(every) + 1})
    g, b = (F.col("g") + 1).cast("double"), (F.col("b") + 1).cast("double")
    part = (b / F.col("ba") - g / F.col("ga")) * F.ln((b / g) / (F.col("ba").cast("double") / F.col("ga")))
    return placed.groupBy("col_name").agg(F.sum(part).alias("iv"))


def t_test_p(spark: SparkSession, t: float, dof: int) -> float:
    return jvm.t_two_sided_p(spark, t, dof)


def apply_rules(rules: list[tuple[Column, list[float]]], size: int = 2) -> Column:
    """The value of the first rule that holds; -1 throughout where none does."""
    default = F.array(*[F.lit(-1.0)] * size)
    return F.coalesce(*[F.when(rule, F.array(*map(F.lit, map(float, values)))) for rule, values in rules], default)
