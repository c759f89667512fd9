"""Sliding windows from panes: partial aggregates of each entity and day, kept as a table.

A day's rows are aggregated once, when they come; any windows of a spec are then combined from panes in one scan of them. Conditions on
window position columns depend on the day only, so they are decided when panes are combined; all others when panes are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.aggregates import lookup
from scorewright.plans.features import expand_all
from scorewright.plans.specs import Feature, FeatureSpec, TableSpec

#: Partial aggregates of a pane by name, over the values x of its rows: about the pane's own mean where squares are summed.
PARTIALS: dict[str, Callable[[Column], Column]] = {
    "n": F.count, "s": F.sum, "m": lambda x: F.count(x) * F.var_pop(x), "c": lambda x: F.sum(F.pow(x, F.lit(3))), "lo": F.min, "hi": F.max,
    "a": lambda x: F.sum(F.abs(x)), "alo": lambda x: F.min(F.abs(x)), "ahi": lambda x: F.max(F.abs(x)),
}
#: Partial aggregates that each function needs.
NEEDS = {"SUM": "s", "AVG": "s n", "MAX": "hi", "MIN": "lo", "STD": "n s m", "COUNT": "n", "CNT": "n", "SUMABS": "a", "MAXABS": "ahi", "MINABS": "alo", "AVGABS": "a n", "SKEW": "n s m c", "PCTSUM": "s", "PCTCNT": "n"}


def _text(parts, windowed: set[str], inside: bool) -> str:
    """The conditions on window position columns (inside), or all others."""
    return " and ".join(["1=1", *(f"({expr})" for col, expr in parts if (col in windowed) == inside)])


class Panes:
    """The panes of some specs over a flow table, in a folder that all executors reach. day: a date, timestamp or text column of the event."""

    def __init__(self, spark: SparkSession, path: str, specs: list[FeatureSpec], entity: list[str], table: TableSpec, day: str) -> None:
        self.spark, self.path, self.specs, self.entity, self.table, self.day = spark, path, specs, entity, table, day
        self.features: dict[str, list[Feature]] = {w: expand_all(specs, entity, table, w) for w in table.win_nm}
        every = [f for fs in self.features.values() for f in fs]
        if odd := sorted({f.function for f in every if f.function not in NEEDS and not lookup(f.function).distinct}):
            raise ValueError(f"not to be put together from panes: {odd}")
        windowed = table.windowed()
        #: (object, other conditions) -> number, of sums and of distinct counts
        self.sums: dict[tuple[str, str], int] = {}
        self.seen: dict[tuple[str, str], int] = {}
        needed: dict[tuple[str, str], set[str]] = {}
        for f in every:
            for parts in (f.parts, f.base_parts) if lookup(f.function).ratio else (f.parts,):
                key = (f.object, _text(parts, windowed, False))
                if lookup(f.function).distinct:
                    self.seen.setdefault(key, len(self.seen))
                else:
                    self.sums.setdefault(key, len(self.sums))
                    needed.setdefault(key, set()).update(NEEDS[f.function].split())
        self.partials = [(f"__{kind}{k}", kind, *key) for key, k in self.sums.items() for kind in sorted(needed[key])]

    def append(self, rows: DataFrame) -> None:
        """Add or replace the panes of the rows' days; panes of other days aren't read. All rows of a day must come together.

        Rows without a day take no part. A repeated run changes nothing."""
        dated = rows.withColumn("__day", F.to_date(self.day)).filter("__day IS NOT NULL")
        columns = [PARTIALS[kind](F.when(F.expr(text), F.col(obj))).alias(name) for name, kind, obj, text in self.partials]
        self._write(dated.groupBy(*self.entity, "__day").agg(F.count("*").alias("__rows"), *columns), "sums")
        for obj in dict.fromkeys(o for o, _ in self.seen):
            flags = [F.max(F.expr(text)).alias(f"__f{k}") for (o, text), k in self.seen.items() if o == obj]
            values = dated.filter(F.col(obj).isNotNull()).groupBy(*self.entity, "__day", F.col(obj).alias("__value")).agg(*flags)
            self._write(values, f"seen-{obj}")

    def _write(self, panes: DataFrame, label: str) -> None:
        panes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__day").parquet(f"{self.path}/{label}")

    def compute(self, asof: dict[str, Column]) -> DataFrame:
        """entity, window and all features: a row for each entity and window, from one scan of the sums and one of each object's values.

        asof: the reference date of each window, as a column of no table (a literal)."""
        windowed = self.table.windowed()
        days = {f"{c[0]}_{w}": F.datediff(F.to_date(at), F.col("__day")) for c in self.table.winpos_col for w, at in asof.items()}
        sums = self.spark.read.parquet(f"{self.path}/sums").withColumns(days)
        chosen = [(w, i, f) for w in asof for i, f in enumerate(self.features[w])]
        plain = [(w, i, f) for w, i, f in chosen if not lookup(f.function).distinct]
        out = sums.groupBy(*self.entity).agg(F.sum("__rows").alias("__rows"), *[self._combined(f, windowed).alias(f"__{w}_{i}") for w, i, f in plain])
        for obj in dict.fromkeys(f.object for _, _, f in chosen if lookup(f.function).distinct):
            mine = [(w, i, f) for w, i, f in chosen if lookup(f.function).distinct and f.object == obj]
            out = self._joined(out, obj, mine, days, windowed)
        rows = [F.struct(F.lit(w).alias("window"), *[F.col(f"__{w}_{i}").alias(f.alias) for i, f in enumerate(self.features[w])]) for w in asof]
        return out.select(*self.entity, F.explode(F.array(*rows)).alias("__row")).select(*self.entity, "__row.*")

    def _combined(self, f: Feature, windowed: set[str]) -> Column:
        def part(kind: str, parts=f.parts) -> Column:
            value = F.when(F.expr(_text(parts, windowed, True)), F.col(f"__{kind}{self.sums[f.object, _text(parts, windowed, False)]}"))
            if kind == "n":
                return F.coalesce(F.sum(value), F.lit(0))
            return {"lo": F.min, "hi": F.max, "alo": F.min, "ahi": F.max}.get(kind, F.sum)(value)

        def deviation() -> Column:
            """Squares about the panes' means, and of these about the mean of all."""
            k, inside = self.sums[f.object, _text(f.parts, windowed, False)], F.expr(_text(f.parts, windowed, True))
            means = F.sum(F.when(inside, F.try_divide(F.pow(F.col(f"__s{k}").cast("double"), F.lit(2)), F.col(f"__n{k}"))))
            variance = F.try_divide(part("m") + means - F.try_divide(F.pow(part("s").cast("double"), F.lit(2)), part("n")), part("n"))
            return F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance))

        name = f.function
        if name in ("PCTSUM", "PCTCNT"):
            kind = "s" if name == "PCTSUM" else "n"
            return F.try_divide(part(kind), part(kind, f.base_parts))
        if name in ("AVG", "AVGABS"):
            return F.try_divide(part("s" if name == "AVG" else "a").cast("double"), part("n"))
        if name == "STD":
            return deviation()
        if name == "SKEW":
            mean, d = F.try_divide(part("s").cast("double"), part("n")), deviation()
            return (F.try_divide(part("c"), part("n")) - 3 * mean * F.pow(d, F.lit(2)) - F.pow(mean, F.lit(3))) / (F.pow(d, F.lit(3)) + 0.01)
        return part(NEEDS[name])

    def _joined(self, out: DataFrame, obj: str, mine: list, days: dict[str, Column], windowed: set[str]) -> DataFrame:
        """out with the distinct counts of an object: a value counts if a pane with it lies inside the window."""
        wanted = list(dict.fromkeys(parts for _, _, f in mine for parts in ((f.parts, f.base_parts) if lookup(f.function).ratio else (f.parts,))))
        keys = [f"__e{k}" for k in range(len(self.entity))]
        values = self.spark.read.parquet(f"{self.path}/seen-{obj}").withColumns(days)
        flags = [F.max(F.when(F.expr(_text(p, windowed, True)) & F.col(f"__f{self.seen[obj, _text(p, windowed, False)]}"), 1).otherwise(0)).alias(f"__c{k}") for k, p in enumerate(wanted)]
        counts = values.groupBy(*[F.col(e).alias(k) for e, k in zip(self.entity, keys, strict=True)], "__value").agg(*flags)
        counts = counts.groupBy(*keys).agg(*[F.sum(f"__c{k}").alias(f"__c{k}") for k in range(len(wanted))])
        found = {p: F.coalesce(F.col(f"__c{k}"), F.lit(0).cast("long")) for k, p in enumerate(wanted)}
        columns = [(F.try_divide(found[f.parts], found[f.base_parts]) if lookup(f.function).ratio else found[f.parts]).alias(f"__{w}_{i}") for w, i, f in mine]
        joined = out.join(counts, [F.col(e).eqNullSafe(F.col(k)) for e, k in zip(self.entity, keys, strict=True)], "left")
        return joined.select(*out.columns, *columns)
