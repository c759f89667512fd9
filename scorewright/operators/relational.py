"""Relational shapes of the overdue reports: top row of a key, branches in a union, explode before ranking, left-join chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. The order must end in a tiebreak for the result to be determined.

    Spark limits each task's groups to n rows before the shuffle, so a hot key moves n rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).filter(F.col("__rn") <= n).drop("__rn")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each distinct key, the first in order; keys that are null are a key like others."""
    return top_per_key(df, keys, order)


def first_number(text: Column) -> Column:
    """The first number of a comma list, or the text as a number; null where it isn't one."""
    return F.when(text.like("%,%"), F.get(F.split(text, ","), F.lit(0))).otherwise(text).try_cast("int")


def due_days(paid: Column, first_due: Column, months: Column) -> Column:
    """Days from the due date of a period, `months` after the first one, to the payment."""
    return F.datediff(F.to_date(paid), F.add_months(F.to_date(first_due), months))


def union_all(branches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), branches)


def overdue(branches: list[DataFrame], entity: str, least_days: int) -> DataFrame:
    """The longest delay of each entity over all branches (entity, due_days) where it exceeds least_days."""
    return union_all(branches).filter(F.col("due_days") > least_days).groupBy(entity).agg(F.max("due_days").alias("due_days"))


def times_amount(df: DataFrame, entity: str, contract: str, periods: Column, amount: str, paid: str, ties: list[Column]) -> DataFrame:
    """entity, last_payment_due_date, ovd_times, ovd_total_amt.

    A contract's rows are exploded by period first and ranked by amount afterwards, so the largest amount counts once for a contract, times
    its number of distinct periods. The first row of a contract is the least of its rows' keys (in partial minima), so no contract is ordered by one task."""
    exploded = df.select(entity, contract, amount, paid, *[t.alias(f"__t{k}") for k, t in enumerate(ties)], F.explode(periods).alias("period"))
    value = F.col(amount).cast("double")
    place = F.struct(value.isNull(), -value, *[F.col(f"__t{k}") for k in range(len(ties))], F.col("period"))
    first = exploded.groupBy(F.col(contract).alias("__contract")).agg(F.min_by(F.struct(F.col(entity).alias("e"), F.col(amount).alias("a")), place).alias("__first"))
    contracts = exploded.groupBy(entity, contract).agg(F.countDistinct("period").alias("ovd_times"), F.count("*").alias("__rows"), F.max(paid).alias("last_payment_due_date"))
    joined = contracts.join(first, F.col(contract).eqNullSafe(F.col("__contract")))
    largest = F.when(F.col("__first.e").eqNullSafe(F.col(entity)), F.when(F.col("__rows") > 1, F.coalesce(F.col("__first.a"), F.lit(0))).otherwise(F.col("__first.a"))).otherwise(F.lit(0))
    contracts = joined.select(entity, "ovd_times", "last_payment_due_date", (F.col("ovd_times") * largest).alias("ovd_total_amt"))
    return contracts.groupBy(entity).agg(F.max("last_payment_due_date").alias("last_payment_due_date"), F.sum("ovd_times").alias("ovd_times"), F.sum("ovd_total_amt").alias("ovd_total_amt"))


def left_chain(base: DataFrame, steps: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Left outer joins one after the other; a match that fans out stays fanned out. Catalyst picks each join's strategy."""
    return reduce(lambda df, step: df.join(step[0], step[1], "left"), steps, base)


def map_values(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """df[col] replaced through a (key, value) table; what it lacks becomes the default, or null."""
    found = df.join(mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col(col) == F.col("__k"), "left")
    mapped = F.coalesce("__v", default) if default is not None else F.col("__v")
    return found.withColumn(col, mapped).drop("__k", "__v")
