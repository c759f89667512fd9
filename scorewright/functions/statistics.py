"""Tail probabilities as column functions, by numpy over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of a series or continued fraction at most, and the change at which one ends.
TERMS, CLOSE = 10_000, 1e-15
TINY = 1e-300


def _log_gamma(a: np.ndarray) -> np.ndarray:
    values, place = np.unique(a, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[place].reshape(a.shape)


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function: a power series of the lower one below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(x.shape)
    head = np.exp(np.where(x > 0, a * np.log(np.maximum(x, TINY)) - x, -np.inf) - _log_gamma(a))
    low = (x > 0) & (x < a + 1)
    term = total = 1 / a[low]
    n = a[low].copy()
    for _ in range(TERMS):
        n = n + 1
        term = term * x[low] / n
        total = total + term
        if not (term > total * CLOSE).any():
            break
    out[low] = 1 - head[low] * total
    high = (x > 0) & ~low
    b = x[high] + 1 - a[high]
    c, d = np.full(b.shape, 1 / TINY), 1 / np.where(b == 0, TINY, b)
    h = d.copy()
    for k in range(1, TERMS):
        step = -k * (k - a[high])
        b = b + 2
        d = 1 / _apart(step * d + b)
        c = _apart(b + step / c)
        h = h * c * d
        if not (np.abs(c * d - 1) > CLOSE).any():
            break
    out[high] = head[high] * h
    return np.clip(out, 0, 1)


def _apart(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < TINY, TINY, x)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by the continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    c, d = np.ones(y.shape), 1 / _apart(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for k in range(1, TERMS):
        for step in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 / _apart(1 + step * d)
            c = _apart(1 + step / c)
            h = h * c * d
        if not (np.abs(c * d - 1) > CLOSE).any():
            break
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    found = np.where(inside, front * h, np.where(y >= 1, 1.0, 0.0))
    return np.clip(np.where(turn, 1 - found, found), 0, 1)


@F.pandas_udf(DoubleType())
def _chi2_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    known = statistic.notna() & dof.notna() & (dof > 0)
    out = pd.Series(np.nan, statistic.index)
    out[known] = gamma_tail(dof[known].to_numpy(float) / 2, statistic[known].to_numpy(float) / 2)
    return out.astype(object).where(known, None)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    known = t.notna() & dof.notna() & (dof > 0)
    v, x = dof[known].to_numpy(float), t[known].to_numpy(float)
    out = pd.Series(np.nan, t.index)
    half, square = np.full(v.shape, 0.5), x * x
    out[known] = np.where(square < v, 1 - beta_share(half, v / 2, square / (v + square)), beta_share(v / 2, half, v / (v + square)))
    return out.astype(object).where(known, None)


def chi2_p(statistic: Column, dof: Column) -> Column:
    """P(X > statistic) for the chi-square distribution; null for a null or without degrees of freedom."""
    return _chi2_p(statistic.cast("double"), dof.cast("double"))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """P(abs(T) > abs(t)) for Student's distribution; null for a null or without degrees of freedom."""
    return _t_p(t.cast("double"), dof.cast("double"))
