"""Features over a stream of events: the batch specs in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.aggregates import lookup
from scorewright.plans.features import expand_all
from scorewright.plans.specs import Feature, FeatureSpec


def windowed_features(events: DataFrame, specs: list[FeatureSpec], entity: list[str], time: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, window_end, the entities and the features; works on streams and on tables.

    Events later than `late` behind the newest are dropped on a stream, and state of closed windows with them. Distinct counts are a
    second aggregation over one row for each value seen in a window; on a stream both keep their state until the watermark closes the window,
    so the values of a window are state while it is open, and results come in append mode, when it has closed."""
    features = expand_all(specs, entity)
    stamped = events.withColumn("__time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__time", late)
    plain = [f for f in features if not lookup(f.function).distinct]
    distinct = [f for f in features if lookup(f.function).distinct]
    if not distinct:
        grouped = stamped.groupBy(F.window("__time", window, slide), *entity).agg(*[_column(f, F.lit(True)) for f in plain])
    else:
        grouped = _with_values(stamped, plain, distinct, entity, F.window("__time", window, slide))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *entity, *[f.alias for f in features])


def _column(f: Feature, on: Column) -> Column:
    value = F.col(f.object)
    return lookup(f.function).column(F.when(on & F.expr(f.predicate), value), F.when(on & F.expr(f.base_predicate), value)).alias(f.alias)


def _with_values(stamped: DataFrame, plain: list[Feature], distinct: list[Feature], entity: list[str], window: Column) -> DataFrame:
    """Every event is one row for the plain features (role 0) and one for each object with distinct counts, which carries its value. Rows are first
    grouped by window, entity, role and value, then by window and entity."""
    objects = list(dict.fromkeys(f.object for f in distinct))
    conditions = list(dict.fromkeys((f.object, p) for f in distinct for p in ([f.predicate, f.base_predicate] if lookup(f.function).ratio else [f.predicate])))
    roles = [F.struct(F.lit(0).alias("role"), F.lit(None).cast("string").alias("value"))] + [F.struct(F.lit(k).alias("role"), F.col(o).cast("string").alias("value")) for k, o in enumerate(objects, 1)]
    rows = stamped.withColumn("__role", F.explode(F.array(*roles)))
    role, there = F.col("__role.role"), F.col("__role.value").isNotNull()
    flags = [F.max(F.when((role == objects.index(o) + 1) & there & F.expr(p), 1).otherwise(0)).alias(f"__flag{k}") for k, (o, p) in enumerate(conditions)]
    seen = rows.groupBy(window.alias("window"), *entity, role.alias("__number"), F.col("__role.value").alias("__value")).agg(*[_column(f, role == 0) for f in plain], *flags)
    counts = {c: F.sum(f"__flag{k}") for k, c in enumerate(conditions)}
    numbers = [(F.try_divide(counts[f.object, f.predicate], counts[f.object, f.base_predicate]) if lookup(f.function).ratio else counts[f.object, f.predicate]).alias(f.alias) for f in distinct]
    own = [F.max(F.when(F.col("__number") == 0, F.col(f.alias))).alias(f.alias) for f in plain]
    return seen.groupBy("window", *entity).agg(*own, *numbers)
