"""Binning: quantile, equal width, given edges, and chi-square merging. Bins are right-closed and numbered from 0."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright import jvm
from scorewright.functions.expressions import edges, right_closed_bin
from scorewright.operators.profile import merge_categories
from scorewright.operators.selection import column_quantiles
from scorewright.shipping import ship

#: Values below this many rows of a category join the merged category.
RARE = 36


def quantile_cuts(df: DataFrame, col: str, bins: int) -> list[float]:
    """Distinct quantiles at 1/n, .., (n-1)/n, with linear interpolation, without the ends that would leave a bin empty."""
    return all_quantile_cuts(df, [col], bins)[col]


def all_quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """quantile_cuts of many columns, from the same few jobs."""
    found = column_quantiles(df, columns, [i / bins for i in range(1, bins)] + [1.0])
    return {c: sorted({q for q in found[None, c][:-1] if q < found[None, c][-1]}) if (None, c) in found else [] for c in columns}


def quantiles(df: DataFrame, col: str, shares: list[float]) -> tuple[list[float], float | None]:
    """Exact quantiles with linear interpolation, and the largest value; without values, none and null. NaN counts as missing."""
    found = column_quantiles(df, [col], [*shares, 1.0]).get((None, col))
    return (found[:-1], found[-1]) if found else ([], None)


def width_cuts(df: DataFrame, col: str, bins: int) -> list[float]:
    low, high = df.agg(F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double"))).first()
    return [] if low is None else sorted({low + i * (high - low) / bins for i in range(1, bins)})


def cut(df: DataFrame, col: str, method: str, bins: int = 10, cut_points: list[float] | None = None, out: str = "bin") -> tuple[DataFrame, list[float]]:
    """df with a bin column, and the inner edges. method: 'qcut', 'wcut', or 'cust' with edges of the caller's (infinities are dropped)."""
    if method == "qcut":
        cuts = quantile_cuts(df, col, bins)
    elif method == "wcut":
        cuts = width_cuts(df, col, bins)
    elif method == "cust":
        cuts = sorted({float(c) for c in cut_points or [] if math.isfinite(c)})
    else:
        raise ValueError(f"unknown binning {method}")
    return df.withColumn(out, right_closed_bin(F.col(col).cast("double"), edges(cuts))), cuts


def chi2(table: list[list[float]], yates: bool = True) -> tuple[float, int]:
    """Statistic and degrees of freedom of a contingency table; an empty row or column adds nothing. 2x2 tables are Yates-corrected."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    n, dof = sum(rows), (len(rows) - 1) * (len(cols) - 1)
    total = 0.0
    for i, r in enumerate(table):
        for j, observed in enumerate(r):
            expected = rows[i] * cols[j] / n if n else 0
            if expected:
                gap = abs(observed - expected)
                if yates and dof == 1:
                    gap -= min(0.5, gap)
                total += gap * gap / expected
    return total, dof


def chi2_test(spark: SparkSession, table: list[list[float]]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom, p. An expected count of zero is an error, as the test has no meaning there."""
    if not all(sum(r) for r in table) or not all(map(sum, zip(*table, strict=True))):
        raise ValueError("an expected count is zero")
    statistic, dof = chi2(table)
    return statistic, dof, jvm.chi2_p(spark, statistic, dof)


def crosstab(df: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    """Counts of row values by column values, a column each, 0 where there are none."""
    pivot = df.groupBy(row).pivot(col, values) if values else df.groupBy(row).pivot(col)
    return pivot.agg(F.count(F.lit(1))).na.fill(0)


def _against(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """chi2 of the table of `one` and each of the others."""
    row, rows, cols = one.sum(), others.sum(axis=1), one + others
    total = np.zeros(len(others))
    for observed, margin in ((one, row), (others, rows[:, None])):
        expected = margin * cols / np.maximum(row + rows, 1e-300)[:, None]
        gap = np.abs(observed - expected)
        if len(one) == 2:
            gap = gap - np.minimum(0.5, gap)
        total += np.divide(gap * gap, expected, out=np.zeros_like(gap), where=expected > 0).sum(axis=1)
    return total


@dataclass
class _Merging:
    """Groups with their counts; of all pairs that with the least chi-square merges first, of equals the foremost.

    Each group knows its best partner after it, so memory grows with the groups, not with their pairs."""

    groups: list
    counts: list[list[float]]

    def run(self, bins: int | None, threshold: float) -> None:
        counts, alive = np.array(self.counts, float), np.ones(len(self.groups), bool)
        best, partner = np.full(len(counts), np.inf), np.full(len(counts), -1)

        def look(i: int) -> None:
            after = np.flatnonzero(alive[i + 1 :]) + i + 1
            best[i], partner[i] = np.inf, -1
            if len(after):
                values = _against(counts[i], counts[after])
                best[i], partner[i] = values.min(), after[values.argmin()]

        for i in range(len(counts)):
            look(i)
        left = len(counts)
        while left > 2 and not (left <= bins if bins else best.min() >= threshold):
            i = int(best.argmin())
            j = int(partner[i])
            counts[i] += counts[j]
            self.groups[i] = self.groups[i] + self.groups[j]
            alive[j], best[j], left = False, np.inf, left - 1
            changed = alive & ((partner == i) | (partner == j))
            changed[i] = True
            before = np.flatnonzero(alive[:i] & ~changed[:i])
            if len(before):  # the merged group may be a better partner now
                values = _against(counts[i], counts[before])
                nearer = (values < best[before]) | ((values == best[before]) & (i < partner[before]))
                best[before[nearer]], partner[before[nearer]] = values[nearer], i
            for k in np.flatnonzero(changed):
                look(int(k))
        self.groups, self.counts = [g for g, on in zip(self.groups, alive, strict=True) if on], counts[alive].tolist()


def _table(df: DataFrame, by: str, target: str) -> tuple[list, list[list[float]]]:
    """Counts of the (few) bins by class, from one aggregation."""
    rows = df.filter(F.col(by).isNotNull()).groupBy(by, target).agg(F.count("*").alias("n")).collect()
    classes = sorted({r[target] for r in rows}, key=str)
    names = sorted({r[by] for r in rows})
    counts = {(r[by], r[target]): float(r["n"]) for r in rows}
    return names, [[counts.get((b, c), 0.0) for c in classes] for b in names]


def _threshold(spark: SparkSession, classes: int, confidence: float | None) -> float:
    return jvm.chi2_isf(spark, 0.05 if confidence is None else 1 - confidence, max(1, classes - 1))


def merge_neighbours(counts: np.ndarray, bins: int | None, threshold: float) -> list[int]:
    """The last bin of each group after merging the neighbours of least chi-square, of equals the foremost, down to `bins` groups or until all
    differ by the threshold; never under two. Groups are a linked list and their differences a heap, whose entries of groups
    that have changed since are passed over when they come up."""
    counts, n = np.array(counts, float), len(counts)
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    last, version = list(range(n)), [0] * n
    heap: list[tuple[float, int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            j = after[i]
            heapq.heappush(heap, (float(_against(counts[i], counts[j][None])[0]), i, version[i], version[j]))

    for i in range(n - 1):
        push(i)
    left = n
    while heap and left > 2:
        value, i, mine, other = heapq.heappop(heap)
        j = after[i]
        if j < 0 or version[i] != mine or version[j] != other:
            continue
        if left <= bins if bins else value >= threshold:
            break
        counts[i] += counts[j]
        last[i], after[i] = last[j], after[j]
        if after[j] >= 0:
            before[after[j]] = i
        version[i], version[j], left = version[i] + 1, -1, left - 1
        push(i)
        push(before[i])
    found, i = [], 0
    while i >= 0 and n:
        found.append(last[i])
        i = after[i]
    return found


def bin_counts(df: DataFrame, cuts: dict[str, list[float]], target: str) -> DataFrame:
    """col_name, bin, target, n of all binned columns, in one aggregation."""
    binned = [right_closed_bin(F.col(c).cast("double"), edges(e)).alias(f"b{k}") for k, (c, e) in enumerate(cuts.items())]
    names = F.create_map(*[F.lit(v) for k, c in enumerate(cuts) for v in (f"b{k}", c)])
    long = df.select(F.col(target).alias("target"), *binned).unpivot(["target"], [f"b{k}" for k in range(len(cuts))], "place", "bin").filter("bin IS NOT NULL")
    return long.groupBy("place", "bin", "target").agg(F.count("*").alias("n")).select(names[F.col("place")].alias("col_name"), "bin", "target", "n")


def chimerge_columns(df: DataFrame, columns: list[str], target: str, bins: int | None = None, confidence: float | None = None, start_bins: int = 100) -> DataFrame:
    """col_name, cuts: the inner edges of each column after merging neighbouring quantile bins, down to `bins`, or until all neighbours differ significantly.

    Quantiles and counts of all columns are a fixed number of jobs; a column's counts (start_bins times classes) are merged by a task of their own.
    A column without values has no edges."""
    cuts = all_quantile_cuts(df, columns, start_bins)
    classes = df.select(target).distinct().count()
    thresholds = {k: _threshold(df.sparkSession, k, confidence) for k in range(1, classes + 1)}
    ship(df.sparkSession)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["col_name"].iloc[0]
        table = rows.assign(target=rows["target"].map(str)).pivot_table(index="bin", columns="target", values="n", fill_value=0, dropna=False).sort_index()
        lasts = merge_neighbours(table.to_numpy(), bins, thresholds[table.shape[1]])
        return pd.DataFrame({"col_name": [name], "cuts": [[cuts[name][int(table.index[k])] for k in lasts[:-1]]]})

    found = bin_counts(df, cuts, target).groupBy("col_name").applyInPandas(merge, "col_name string, cuts array<double>")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "col_name string")
    return every.join(found, "col_name", "left").select("col_name", F.coalesce("cuts", F.expr("CAST(array() AS array<double>)")).alias("cuts"))


def chimerge(df: DataFrame, col: str, target: str, bins: int | None = None, confidence: float | None = None, start_bins: int = 100) -> list[float]:
    """The edges of one column, see chimerge_columns."""
    return list(chimerge_columns(df, [col], target, bins, confidence, start_bins).first()["cuts"])


def chimerge_categories(df: DataFrame, col: str, target: str, bins: int | None = None, confidence: float | None = None, rare: int = RARE, most: int = 20_000) -> DataFrame:
    """col, bucket: each category's bucket after merging the pair of categories that differ least, over and over; rare categories start as one.

    Only counts of categories with `rare` rows or more reach the driver; over `most` of them are an error, as the merge takes their number
    squared in time. Rare categories stay in the table that comes out. Null is no category."""
    sizes = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    if sizes.filter(F.col("n") >= rare).limit(most + 1).count() > most:
        raise ValueError(f"over {most} categories: use a higher `rare`")
    tag = "\0rare"  # no category is named so
    names, counts = _table(merge_categories(df.select(col, target), col, rare, tag), col, target)
    merging = _Merging([[name] for name in names], counts)
    merging.run(bins, _threshold(df.sparkSession, len(counts[0]) if counts else 1, confidence))
    buckets = df.sparkSession.createDataFrame([(name, k) for k, group in enumerate(merging.groups) for name in group], "merged string, bucket int")
    merged = F.when(F.col("n") < rare, F.lit(tag)).otherwise(F.col("v"))
    return sizes.select("v", merged.alias("merged")).join(buckets, "merged").select(F.col("v").alias(col), "bucket")
