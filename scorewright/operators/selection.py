"""Exact order statistics at any size: of many columns at once, and of many groups at once.

Columns: a double's bits, read as a number, keep its order. Each round counts the next bits of the values that may still hold a wanted
rank, over all columns and groups in one job, and keeps only the bucket of each rank. Groups: values are counted, dealt by range of (group, value),
and each range knows how many values of its groups lie before it, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.session import cut
from scorewright.shipping import ship

#: Bits that the first and the later rounds look at; when so few values are left, one round looks at all the other bits.
FIRST_BITS, NEXT_BITS, FEW = 16, 13, 100_000
#: Counted prefixes of one partition that are held before they are added up.
HELD = 1 << 20


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the (double) values; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(bits: int) -> float:
    bits = np.int64(bits)
    return float((bits if bits >= 0 else bits ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64))


def _counted(df: DataFrame, columns: int, wanted: dict[tuple, np.ndarray] | None, shift: int, width: int) -> DataFrame:
    """(g, c, p, n): values of column c in group g by their bits above `shift`, where the bits above shift + width are among wanted[g, c]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            parts = []
            for (g, c), found in held.items():
                p, place = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
                parts.append((g, c, p, np.bincount(place, np.concatenate([b for _, b in found])).astype(np.int64)))
            held.clear()
            names = [g for g, _, p, _ in parts for _ in range(len(p))]
            numbers = [np.concatenate([np.full(len(p), c) for _, c, p, _ in parts] or [[]]), np.concatenate([p for *_, p, _ in parts] or [[]]), np.concatenate([n for *_, n in parts] or [[]])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x.astype(t)) for x, t in zip(numbers, (np.int32, np.int64, np.int64), strict=True)]], names=["g", "c", "p", "n"])

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            index, names = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary.to_pylist()
            index = np.where(np.isnan(index), -1, index).astype(int) if index.dtype.kind == "f" else index
            for c in range(columns):
                x = batch.column(1 + c).to_numpy(zero_copy_only=False)
                for k, g in [*enumerate(names), (-1, None)]:
                    mine = x[index == k]
                    mine = ordered_bits(mine[~np.isnan(mine)])
                    if wanted is not None:
                        ours = wanted.get((g, c))
                        mine = mine[np.isin(mine >> (shift + width), ours)] if ours is not None else mine[:0]
                    if len(mine):
                        found = np.unique(mine >> shift, return_counts=True)
                        held.setdefault((g, c), []).append(found)
                        size += len(found[0])
            if size >= HELD:
                yield rows()
                size = 0
        yield rows()

    return df.mapInArrow(run, "g string, c int, p long, n long").groupBy("g", "c", "p").agg(F.sum("n").alias("n"))


def column_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: str | None = None) -> dict[tuple, list[float]]:
    """(group, column) -> exact quantiles with linear interpolation at the shares. One group None without `by`; groups are texts and few.

    All columns and groups take part in each job, and there are at most six. Null and NaN count as missing; a column without values has no entry."""
    ship(df.sparkSession)
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    values = df.select(group.alias("g"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    shift, width = 64 - FIRST_BITS, FIRST_BITS
    counts = _counted(values, len(columns), None, shift, width)
    spread = F.array(*[F.lit(float(s)) for s in shares])
    whole, run = Window.partitionBy("g", "c"), Window.partitionBy("g", "c").orderBy("p")
    placed = counts.withColumns({"total": F.sum("n").over(whole), "last": F.sum("n").over(run)})
    ranks = F.array_distinct(F.flatten(F.transform(spread, lambda s: F.array(F.floor((F.col("total") - 1) * s), F.ceil((F.col("total") - 1) * s)))))
    here = F.filter(ranks, lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("n")))
    found = placed.withColumn("here", here).filter(F.size("here") > 0).select("g", "c", "p", "n", "last", "total", "here").collect()
    totals = {(r["g"], r["c"]): r["total"] for r in found}
    #: (group, column, rank) -> the bits known so far, and how many values lie before them
    state = {(r["g"], r["c"], k): (r["p"], r["last"] - r["n"]) for r in found for k in r["here"]}
    left = sum({(r["g"], r["c"], r["p"]): r["n"] for r in found}.values())
    while shift and state:
        width = shift if left <= FEW else min(NEXT_BITS, shift)
        shift -= width
        wanted: dict[tuple, set] = {}
        for (g, c, _), (p, _) in state.items():
            wanted.setdefault((g, c), set()).add(p)
        counts = _counted(values, len(columns), {k: np.array(sorted(v)) for k, v in wanted.items()}, shift, width)
        asked = df.sparkSession.createDataFrame([(g, c, p, rank - before, rank) for (g, c, rank), (p, before) in state.items()], "g string, c int, above long, place long, rank long")
        above = F.shiftright("p", width) if width < 64 else F.lit(0)
        last = F.sum("n").over(Window.partitionBy("g", "c", "above").orderBy("p"))
        ordered = counts.withColumn("above", above).withColumn("last", last).withColumnsRenamed({"g": "og", "c": "oc", "above": "oabove"})
        same = F.col("g").eqNullSafe(F.col("og")) & (F.col("c") == F.col("oc")) & (F.col("above") == F.col("oabove"))
        hit = (F.col("place") < F.col("last")) & (F.col("place") >= F.col("last") - F.col("n"))
        found = ordered.join(F.broadcast(asked), same & hit).select("g", "c", "rank", "p", "n", (F.col("last") - F.col("n")).alias("before")).collect()  # two ranks a share, column and group
        state = {(r["g"], r["c"], r["rank"]): (r["p"], state[r["g"], r["c"], r["rank"]][1] + r["before"]) for r in found}
        left = sum({(r["g"], r["c"], r["p"]): r["n"] for r in found}.values())
    out = {}
    for (g, c), n in totals.items():
        at = [(n - 1) * s for s in shares]
        ends = [(from_bits(state[g, c, math.floor(p)][0]), from_bits(state[g, c, math.ceil(p)][0]), p - math.floor(p)) for p in at]
        out[g, columns[c]] = [a if a == b else (1 - f) * a + f * b for a, b, f in ends]
    return out


def grouped_select(df: DataFrame, entity: Sequence[str], value: str, conditions: Sequence[str], share: float = 0.5) -> DataFrame:
    """For each entity and condition (SQL text) the smallest value that `share` of the condition's values don't exceed: __e0.., __v0...

    Exact for groups of any size: values are counted by (entity, value), then dealt by range of both; a range's running counts start where
    the entity's ranges before it end. Null values take no part; an entity without a value under a condition has null; entities may be null."""
    keys = [f"__e{k}" for k in range(len(entity))]
    flags = [f"__c{k}" for k in range(len(conditions))]
    rows = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(e).alias(k) for e, k in zip(entity, keys, strict=True)], F.col(value).alias("__value"))
    counts = rows.agg(*[F.count_if(F.expr(p)).alias(f) for p, f in zip(conditions, flags, strict=True)])
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(ranges, *keys, "__value").withColumn("__range", F.spark_partition_id()))
    of_range = [*keys, "__range"]
    sizes = dealt.groupBy(*of_range).agg(*[F.sum(f).alias(f"__n{f}") for f in flags])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_{k}") for k in of_range], *[F.coalesce(F.sum(f"__n{f}").over(earlier), F.lit(0)).alias(f"__b{f}") for f in flags], *[F.ceil(share * F.sum(f"__n{f}").over(whole)).alias(f"__t{f}") for f in flags], *[f"__n{f}" for f in flags])
    holds = [(F.col(f"__t{f}") > F.col(f"__b{f}")) & (F.col(f"__t{f}") <= F.col(f"__b{f}") + F.col(f"__n{f}")) for f in flags]
    starts = starts.filter(F.greatest(*holds, F.lit(False)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in of_range]
    order = Window.partitionBy(*of_range).orderBy("__value")
    running = dealt.join(starts, same).withColumns({f"__l{f}": F.col(f"__b{f}") + F.sum(f).over(order) for f in flags})
    picked = [F.max(F.when((F.col(f"__t{f}") <= F.col(f"__l{f}")) & (F.col(f"__t{f}") > F.col(f"__l{f}") - F.col(f)), F.col("__value"))).alias(f"__v{k}") for k, f in enumerate(flags)]
    return running.groupBy(*keys).agg(*picked)
