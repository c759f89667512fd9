"""Ranges of a numeric column: the first level of two-level sums, ranks and quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.expressions import edges


def marks(df: DataFrame, x: Column) -> list[float]:
    """Inner edges of ranges of about equal numbers of rows: as many ranges as shuffle partitions, 64 to 4,096. Null and NaN take no part."""
    n = min(4096, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = x.cast("double")
    found = df.filter(~F.isnan(x)).agg(F.percentile_approx(x, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_number(x: Column, cuts: list[float]) -> Column:
    """Number of sorted edges below x. A first look finds the block of edges, a second the place in it: 2 * sqrt(n) comparisons for n edges."""
    size = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    if len(blocks) < 2:
        return F.size(F.filter(edges(cuts), lambda c: c < x))
    block = F.size(F.filter(edges([b[0] for b in blocks[1:]]), lambda c: c < x))
    inside = F.element_at(F.array(*map(edges, blocks)), block + 1)
    return block * size + F.size(F.filter(inside, lambda c: c < x))
