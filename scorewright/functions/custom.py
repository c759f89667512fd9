"""Aggregates and table functions of the user's own.

An aggregate is four functions: init() -> state, update(state, values) -> state, merge(state, state) -> state, finish(state) -> value. It becomes a
two-level aggregation: states of (Arrow batch, entity) are made where the rows are, and only states are shuffled, so an entity of any number of
rows is spread over all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import aggregates
from scorewright.shipping import ship


@dataclass(frozen=True)
class Aggregate:
    """States are any objects that pickle takes; values are the numpy array of an entity's values that aren't null, in no order; never empty.
    finish() of the state init() made is the value of an entity without values. returns: the SQL type of the value."""

    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    returns: str = "double"


def aggregate(df: DataFrame, entity: Sequence[str], value: str, conditions: Sequence[str], agg: Aggregate) -> DataFrame:
    """__e0.. (the entity) and __v0.. (the aggregate under each condition, SQL text). Entities may be null; one without values has finish(init())."""
    ship(df.sparkSession)
    keys, xs = [f"__e{k}" for k in range(len(entity))], [f"__x{k}" for k in range(len(conditions))]
    rows = df.select(*[F.col(e).alias(k) for e, k in zip(entity, keys, strict=True)], *[F.when(F.expr(p), F.col(value)).alias(x) for p, x in zip(conditions, xs, strict=True)])
    key_types = ", ".join(f"{k} {t}" for k, t in rows.select(keys).dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            states = []
            for k, x in enumerate(xs):
                values = batch.column(len(keys) + k).take(pa.array(order))
                for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                    mine = values.slice(a, b - a).drop_null().to_numpy(zero_copy_only=False)
                    states.append(pickle.dumps(agg.update(agg.init(), mine) if len(mine) else agg.init()))
            first = batch.select(keys).take(pa.array(np.tile(order[starts], len(xs))))
            number = pa.array(np.repeat(np.arange(len(xs), dtype=np.int32), len(starts)))
            yield pa.RecordBatch.from_arrays([*first.columns, number, pa.array(states, pa.binary())], names=[*keys, "__k", "__state"])

    def finish(table: pa.Table) -> pa.Table:
        state = None
        for s in table.column("__state").to_pylist():
            state = pickle.loads(s) if state is None else agg.merge(state, pickle.loads(s))
        head = table.slice(0, 1).drop_columns(["__state"])
        return head.append_column("__value", pa.array([agg.finish(state)], value_type))

    value_type = _arrow_type(df.sparkSession, agg.returns)
    made = rows.mapInArrow(partial, f"{key_types}, __k int, __state binary").groupBy(*keys, "__k").applyInArrow(finish, f"{key_types}, __k int, __value {agg.returns}")
    return made.groupBy(*keys).agg(*[F.first(F.when(F.col("__k") == k, F.col("__value")), ignorenulls=True).alias(f"__v{k}") for k in range(len(xs))])


def _arrow_type(spark: SparkSession, sql_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"x {sql_type}")["x"].dataType)


def register_aggregate(spark: SparkSession, name: str, agg: Aggregate) -> None:
    """Make an aggregate a feature function for specs, and callable by name in SQL text.

    Specs take the two-level way. In SQL text Spark gives a function all values of a group at once, so there a group has to fit in a task, and refuses built-in aggregates beside it in one SELECT."""

    @F.pandas_udf(agg.returns)
    def in_sql(values: pd.Series) -> float:
        mine = values.dropna().to_numpy()
        return agg.finish(agg.update(agg.init(), mine) if len(mine) else agg.init())

    ship(spark)
    spark.udf.register(name, in_sql)
    aggregates.register(name, lambda x, y: in_sql(x), f"{name}({{x}})", custom=agg)


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Make a class with eval(row) (and, to end a partition, terminate()) a table function in SQL text: SELECT * FROM name(TABLE(t) PARTITION BY ..
    ORDER BY ..). Each partition has an instance of its own and streams past it, row by row; it may hold little of it."""
    ship(spark)
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


class Sessions:
    """Table function (key, time in seconds) -> key, number, began, ended, events: a partition's rows, in order of time, cut where the next row comes over
    GAP seconds after the last. Rows without a time are passed over."""

    GAP = 1800.0

    def __init__(self) -> None:
        self.key = self.began = self.last = None
        self.number = self.events = 0

    def eval(self, row):
        if row[1] is None:
            return
        if self.last is not None and row[1] - self.last > self.GAP:
            yield self.key, self.number, self.began, self.last, self.events
            self.number, self.began, self.events = self.number + 1, None, 0
        self.key = row[0]
        self.began = row[1] if self.began is None else self.began
        self.last, self.events = row[1], self.events + 1

    def terminate(self):
        if self.last is not None:
            yield self.key, self.number, self.began, self.last, self.events
