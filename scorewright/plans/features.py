"""Feature specs to one wide aggregation: checked, expanded, then rendered as Columns or as SQL text."""

from __future__ import annotations

from collections import Counter
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions import custom
from scorewright.functions.aggregates import lookup
from scorewright.operators.selection import grouped_select
from scorewright.plans.specs import Feature, FeatureSpec, TableSpec, substitute


def expand(spec: FeatureSpec, table: TableSpec | None = None, window: str | None = None) -> list[Feature]:
    """All features of a spec: normal functions first, then ratios, in the order of objects, conditions and functions.

    A ratio PCTxxx_COL keeps COL's condition in the numerator and drops it from the denominator; in its alias the other
    conditions come first."""
    if table:
        _check_columns(spec, table)
        if window and window not in table.win_nm:
            raise ValueError(f"unknown window {window}")
    windowed = table.windowed() if table else set()
    choices = []
    for col, options in spec.condition_cols:
        physical = f"{col}_{window}" if window and col.upper() in windowed else col
        choices.append([(col.upper(), substitute(o.expr, physical), o.comment, o.name) for o in options])
    normal = [f for f in spec.function if not _ratio(f)]
    ratios = [f for f in spec.function if _ratio(f)]
    out = []
    for obj in spec.objects:
        for picked in product(*choices):
            for function in normal:
                name = "__".join([spec.tag, function.upper(), obj, *(p[3] for p in picked)])
                out.append(Feature(name, _comment(obj, function, picked), lookup(function).name, obj, _all(picked), parts=_parts(picked)))
        for function in ratios:
            kind, _, over = function.upper().partition("_")
            if over not in {c.upper() for c, _ in spec.condition_cols}:
                raise ValueError(f"{function}: {over or 'no column'} is not a condition column of {spec.tag}")
            for picked in product(*choices):
                rest, own = [p for p in picked if p[0] != over], [p for p in picked if p[0] == over]
                name = "__".join([spec.tag, function.upper().replace("_", ""), obj, *(p[3] for p in [*rest, *own])])
                out.append(Feature(name, _comment(obj, function, [*rest, *own]), lookup(kind).name, obj, _all([*rest, *own]), _all(rest), _parts([*rest, *own]), _parts(rest)))
    return out


def _ratio(function: str) -> bool:
    kind = function.upper().partition("_")[0]
    return lookup(function if "_" not in function else kind).ratio


def _all(picked) -> str:
    return " and ".join(["1=1", *(f"({p[1]})" for p in picked)])


def _parts(picked) -> tuple[tuple[str, str], ...]:
    return tuple((p[0], p[1]) for p in picked)


def _comment(obj: str, function: str, picked) -> str:
    return "|".join([obj, function.upper(), "$", *(p[2] for p in picked)])


def _check_columns(spec: FeatureSpec, table: TableSpec) -> None:
    known = table.columns()
    if odd := {c.upper() for c in [*spec.objects, *(c for c, _ in spec.condition_cols)]} - known:
        raise ValueError(f"{spec.tag}: columns not in the table: {sorted(odd)}")


def expand_all(specs: list[FeatureSpec], entity: list[str], table: TableSpec | None = None, window: str | None = None) -> list[Feature]:
    """Features of several specs; aliases must differ across all of them, entities must be columns of the table."""
    if table and (odd := {e.upper() for e in entity} - table.columns()):
        raise ValueError(f"entities not in the table: {sorted(odd)}")
    features = [f for s in specs for f in expand(s, table, window)]
    if twice := [a for a, n in Counter(f.alias.upper() for f in features).items() if n > 1]:
        raise ValueError(f"repeated aliases: {twice}")
    return features


def compute(df: DataFrame, specs: list[FeatureSpec], entity: list[str], table: TableSpec | None = None, window: str | None = None) -> DataFrame:
    """All features of the entities: one aggregation of partial sums, and one more for each object with distinct counts or with medians.

    A conditional distinct count over an object is the number of its values that any row satisfies the condition with: rows are
    grouped by entity and value with one flag for each condition, then the flags are added up. So no row is expanded, however
    many conditions there are. Medians are selected by ranges of (entity, value), exact for entities of any size."""
    features = expand_all(specs, entity, table, window)
    plain = [f for f in features if not lookup(f.function).distinct and lookup(f.function).share is None and lookup(f.function).custom is None]
    out = df.groupBy(*entity).agg(*map(_column, plain)) if plain else df.select(*entity).distinct()
    keys = [f"__{e}" for e in entity]
    for obj in dict.fromkeys(f.object for f in features if lookup(f.function).distinct):
        mine = [f for f in features if lookup(f.function).distinct and f.object == obj]
        conditions = list(dict.fromkeys(p for f in mine for p in ([f.predicate, f.base_predicate] if lookup(f.function).ratio else [f.predicate])))
        values = df.filter(F.col(obj).isNotNull()).groupBy(*[F.col(e).alias(k) for e, k in zip(entity, keys, strict=True)], F.col(obj).alias("__value"))
        flags = values.agg(*[F.max(F.when(F.expr(p), 1).otherwise(0)).alias(f"__flag{k}") for k, p in enumerate(conditions)])
        counts = flags.groupBy(*keys).agg(*[F.sum(f"__flag{k}").alias(f"__flag{k}") for k in range(len(conditions))])
        found = {p: F.coalesce(F.col(f"__flag{k}"), F.lit(0).cast("long")) for k, p in enumerate(conditions)}
        columns = [F.try_divide(found[f.predicate], found[f.base_predicate]) if lookup(f.function).ratio else found[f.predicate] for f in mine]
        joined = out.join(counts, [F.col(e).eqNullSafe(F.col(k)) for e, k in zip(entity, keys, strict=True)], "left")
        out = joined.select(*out.columns, *[c.alias(f.alias, metadata={"comment": f.comment}) for c, f in zip(columns, mine, strict=True)])
    special = dict.fromkeys((f.object, f.function) for f in features if lookup(f.function).share is not None or lookup(f.function).custom is not None)
    for obj, function in special:
        mine, kind = [f for f in features if (f.object, f.function) == (obj, function)], lookup(function)
        predicates = [f.predicate for f in mine]
        chosen = grouped_select(df, entity, obj, predicates, kind.share) if kind.custom is None else custom.aggregate(df, entity, obj, predicates, kind.custom)
        joined = out.join(chosen, [F.col(e).eqNullSafe(F.col(f"__e{k}")) for k, e in enumerate(entity)], "left")
        out = joined.select(*out.columns, *[F.col(f"__v{k}").alias(f.alias, metadata={"comment": f.comment}) for k, f in enumerate(mine)])
    return out.select(*entity, *[f.alias for f in features])


def _column(f: Feature):
    value = F.col(f.object)
    x, y = F.when(F.expr(f.predicate), value), F.when(F.expr(f.base_predicate), value)
    return lookup(f.function).column(x, y).alias(f.alias, metadata={"comment": f.comment})
