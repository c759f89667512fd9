"""Sequence features: correlation, linear trend, mean change, and window columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.session import cut


def correlation(df: DataFrame, entity: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*entity).agg(F.corr(x, y).alias(f"corr_{x}_{y}"))


def linear_fit(df: DataFrame, entity: list[str], x: str, y: str) -> DataFrame:
    """Slope (rega_x_y) and intercept (regb_x_y) of y over x."""
    return df.groupBy(*entity).agg(*_fit(x, y))


def _fit(x: str, y: str) -> list[Column]:
    return [F.regr_slope(y, x).alias(f"rega_{x}_{y}"), F.regr_intercept(y, x).alias(f"regb_{x}_{y}")]


def sequence_features(df: DataFrame, entity: list[str], order: list[str | Column], correlations: list[tuple[str, str]] = (), fits: list[tuple[str, str]] = (), changes: list[str] = ()) -> DataFrame:
    """Correlations, linear fits and mean changes of several pairs and columns: one aggregation of partial sums, and one order of the table for all changes."""
    columns = [F.corr(x, y).alias(f"corr_{x}_{y}") for x, y in correlations] + [c for x, y in fits for c in _fit(x, y)]
    if not changes:
        return df.groupBy(*entity).agg(*columns)
    changed = average_changes(df, entity, order, changes)
    if not columns:
        return changed
    keys = [f"__e{k}" for k in range(len(entity))]
    found = df.groupBy(*[F.col(e).alias(k) for e, k in zip(entity, keys, strict=True)]).agg(*columns)
    joined = changed.join(found, [F.col(e).eqNullSafe(F.col(k)) for e, k in zip(entity, keys, strict=True)])
    return joined.select(*entity, *[c for c in found.columns if c not in keys], *[f"change_{c}" for c in changes])


def average_change(df: DataFrame, entity: list[str], order: list[str | Column], col: str) -> DataFrame:
    """Mean difference of neighbouring values in order; null without two neighbours that have a value."""
    return average_changes(df, entity, order, [col])


#: Rows that an entity may have, whatever its share, before it is dealt out by ranges.
LEAST_BUSY = 10_000


def average_changes(df: DataFrame, entity: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """Mean differences of neighbouring values in order, of several columns.

    Entities of at most twice an average task's rows (or LEAST_BUSY) are each ordered whole; busy ones, of which there are fewer than half as many as
    tasks, are put together from segments. Both ways have the same steps and differ by rounding only."""
    named = [c for c in order if isinstance(c, str)]
    rows = df.select(*dict.fromkeys([*entity, *named, *columns])) if len(named) == len(order) else df
    counts = rows.groupBy(*entity).agg(F.count("*").alias("__n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST_BUSY, 2 * (counts.agg(F.sum("__n")).first()[0] or 0) / ranges)
    busy = counts.filter(F.col("__n") > limit).select(*[F.col(e).alias(f"__e{k}") for k, e in enumerate(entity)], F.lit(True).alias("__busy"))
    few = busy.collect()  # under ranges / 2 entities by the filter itself
    if not few:
        return _whole_changes(rows, entity, order, columns)
    hot = F.broadcast(df.sparkSession.createDataFrame(few, busy.schema))
    marked = rows.join(hot, [F.col(e).eqNullSafe(F.col(f"__e{k}")) for k, e in enumerate(entity)], "left").drop(*[f"__e{k}" for k in range(len(entity))])
    quiet = _whole_changes(marked.filter("__busy IS NULL").drop("__busy"), entity, order, columns)
    return quiet.unionByName(_segment_changes(marked.filter("__busy").drop("__busy"), entity, order, columns))


def _whole_changes(rows: DataFrame, entity: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """The lag is taken in an inner projection: no window may stand inside an aggregate."""
    before = Window.partitionBy(*entity).orderBy(*order)
    steps = rows.withColumns({f"__d{i}": F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(before) for i, c in enumerate(columns)})
    return steps.groupBy(*entity).agg(*[F.avg(f"__d{i}").alias(f"change_{c}") for i, c in enumerate(columns)])


def _segment_changes(rows: DataFrame, entity: list[str], order: list[str | Column], columns: list[str]) -> DataFrame:
    """Mean differences of busy entities.

    The table is ordered by range of entity and order, so one busy entity is spread over many tasks. The steps of a run of values without a null
    between them add up to its last value less its first, so each range sums the ends and starts of the runs inside its segment of an entity up and keeps
    its first and last value; segments are then joined in order, where runs may go on. So a sum doesn't depend on where ranges are cut."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(ranges, *entity, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(*entity, "__range").orderBy(*order)
    marks = {"__k": F.row_number().over(inside)}
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        marks |= {f"__x{i}": x, f"__p{i}": F.lag(x).over(inside), f"__q{i}": F.lead(x).over(inside)}
    runs = dealt.withColumns(marks).withColumn("__size", F.max("__k").over(Window.partitionBy(*entity, "__range")))
    parts, mean = [], []
    for i, c in enumerate(columns):
        x, before, after = F.col(f"__x{i}"), F.col(f"__p{i}"), F.col(f"__q{i}")
        ends = F.when(after.isNull() & (F.col("__k") < F.col("__size")), x)
        starts = F.when(before.isNull() & (F.col("__k") > 1), x)
        parts += [F.sum(ends).alias(f"__s{i}"), F.sum(starts).alias(f"__t{i}"), F.count(F.when(x.isNotNull(), before)).alias(f"__n{i}"), F.min_by(x, "__k").alias(f"__f{i}"), F.max_by(x, "__k").alias(f"__l{i}")]
    across = Window.partitionBy(*entity).orderBy("__range")  # a row for each range that an entity lies in
    segments = runs.groupBy(*entity, "__range").agg(*parts)
    segments = segments.withColumns({f"__{name}{i}": value for i in range(len(columns)) for name, value in (("b", F.lag(f"__l{i}").over(across)), ("a", F.lead(f"__f{i}").over(across)))})
    for i, c in enumerate(columns):
        first, last = F.col(f"__f{i}"), F.col(f"__l{i}")
        joined = first.isNotNull() & F.col(f"__b{i}").isNotNull()
        ends = F.coalesce(F.sum(f"__s{i}"), F.lit(0.0)) + F.coalesce(F.sum(F.when(F.col(f"__a{i}").isNull(), last)), F.lit(0.0))
        starts = F.coalesce(F.sum(f"__t{i}"), F.lit(0.0)) + F.coalesce(F.sum(F.when(F.col(f"__b{i}").isNull(), first)), F.lit(0.0))
        mean.append(F.try_divide(ends - starts, F.sum(F.col(f"__n{i}") + joined.cast("int"))).alias(f"change_{c}"))
    return segments.groupBy(*entity).agg(*mean)


def window_columns(df: DataFrame, columns: list[str], event: Column, windows: dict[str, Column]) -> DataFrame:
    """Physical columns c_w: for each window name its reference time, and c_w the days from the event to it. `columns` are names of such day counts."""
    return df.withColumns({f"{c}_{w}": F.datediff(F.to_date(asof), F.to_date(event)) for c in columns for w, asof in windows.items()})
