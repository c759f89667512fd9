"""Column expressions shared by the operators: binning, safe conversion, padding, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column, dtype: str) -> Column:
    """NaN counts as missing in floating columns."""
    return F.when(F.isnan(x), None).otherwise(x) if dtype in ("double", "float") else x


def missing(x: Column, dtype: str) -> Column:
    return x.isNull() | F.isnan(x) if dtype in ("double", "float") else x.isNull()


def right_closed_bin(x: Column, cuts: Column) -> Column:
    """Number of inner edges below x: bins are (-inf, c1], (c1, c2], .., (cn, inf), numbered from 0; null stays null."""
    return F.when(x.isNotNull(), F.size(F.filter(cuts, lambda c: c < x)))


def edges(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def as_double(x: Column) -> Column:
    """Trimmed text to double; null where it doesn't parse."""
    return F.trim(x).try_cast("double")


def left_padded(tokens: Column, size: Column | int, pad: int) -> Column:
    """The first `size` tokens, or all of them behind as many pads as are missing."""
    size = F.lit(size) if isinstance(size, int) else size
    room = F.greatest(size - F.size(tokens), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad), room), F.slice(tokens, F.lit(1), size))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exp over an array, stable for large values; null for an empty array."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def softmax(values: Column) -> Column:
    total = log_sum_exp(values)
    return F.transform(values, lambda v: F.exp(v - total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def argmax(scores: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def yates_chi2(a: Column, b: Column, c: Column, d: Column, corrected: bool = True) -> Column:
    """Chi-square of a 2x2 table; each deviation is drawn in by a half at most. Null when a margin is zero."""
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    if corrected:
        gap = F.greatest(gap - F.least(n / 2.0, gap), F.lit(0.0))
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
