"""Products of all pairs of columns, for hundreds of columns: matrix products of Arrow batches, added up block by block.

A task holds a few matrices of columns times columns; blocks of their rows are added up apart from each other, so the number of columns
is bounded by a task's memory (six matrices: 50 MB for 1,000 columns), and the plan doesn't grow with the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.shipping import ship

#: Rows of a matrix that are added up in one task, and rows of the table that one product takes.
BLOCK = 64
CHUNK = 4096


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """The batch as a matrix, NaN where a value is missing."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])


def complete_gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X over the rows that have all values (NaN counts as missing)."""
    ship(df.sparkSession)
    p = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = _values(batch.slice(at, CHUNK))
                x = x[~np.isnan(x).any(axis=1)]
                total += x.T @ x
        blocks = range(0, p, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b : b + BLOCK].ravel() for b in blocks], pa.list_(pa.float64()))], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, 0
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block, total = b, total + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["block", "v"])

    rows = _doubles(df, columns).mapInArrow(partial, "block int, v array<double>").groupBy("block").applyInArrow(add, "block int, v array<double>").collect()  # one matrix
    return np.concatenate([np.array(r["v"]).reshape(-1, p) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros((p, p))


#: Parts of a pair's state: number of rows with both values, both means over them, both sums of squares and the sum of products about the means.
STATE = 6


def _state(x: np.ndarray) -> np.ndarray:
    """The state of all pairs over some rows."""
    there = ~np.isnan(x)
    m = there.astype(float)
    middle = np.where(there.any(axis=0), np.nansum(x, axis=0) / np.maximum(m.sum(axis=0), 1), 0.0)
    z = np.where(there, x - middle, 0.0)
    n = m.T @ m
    sums, squares, products = z.T @ m, (z * z).T @ m, z.T @ z
    size = np.maximum(n, 1)
    a, b = sums / size, (sums / size.T).T
    return np.stack([n, a + middle[:, None], b + middle[None, :], squares - n * a * a, squares.T - n * b * b, products - n * a * b])


def merge_states(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """States over disjoint rows to that of all of them."""
    n = s[0] + t[0]
    share = np.divide(t[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, k = t[1] - s[1], t[2] - s[2], s[0] * share
    return np.stack([n, np.where(s[0] > 0, s[1] + dx * share, t[1]), np.where(s[0] > 0, s[2] + dy * share, t[2]), s[3] + t[3] + dx * dx * k, s[4] + t[4] + dy * dy * k, s[5] + t[5] + dx * dy * k])


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, n, r for all pairs of columns, x before y: rows with both values, and their correlation (null if a side is constant).

    Null and NaN are missing. The table stays distributed: a task makes the rows of some first columns."""
    ship(df.sparkSession)
    p, names = len(columns), list(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                found = _state(_values(batch.slice(at, CHUNK)))
                total = found if total is None else merge_states(total, found)
        if total is not None:
            blocks = range(0, p, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[:, b : b + BLOCK].ravel() for b in blocks], pa.list_(pa.float64()))], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = v.values.to_numpy().reshape(STATE, -1, p)
                block, total = b, found if total is None else merge_states(total, found)
        i, j = np.nonzero(np.arange(total.shape[1])[:, None] + block < np.arange(p)[None, :])
        n, xx, yy, xy = (total[k, i, j] for k in (0, 3, 4, 5))
        scale = np.sqrt(np.maximum(xx, 0) * np.maximum(yy, 0))
        known = (n > 1) & (scale > 0)
        r = np.clip(np.divide(xy, scale, out=np.zeros_like(scale), where=known), -1, 1)
        columns_ = [pa.array([names[k] for k in i + block]), pa.array([names[k] for k in j]), pa.array(n.astype(np.int64)), pa.array(r, mask=~known)]
        yield pa.RecordBatch.from_arrays(columns_, names=["x", "y", "n", "r"])

    return _doubles(df, columns).mapInArrow(partial, "block int, v array<double>").groupBy("block").applyInArrow(add, "x string, y string, n long, r double")
