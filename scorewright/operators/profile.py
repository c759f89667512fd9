"""Column profiling and filters. Every statistic is one job over all columns, never one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.expressions import as_double, missing, null_if_nan

NUMBERS = ("bigint", "double", "int", "float", "smallint", "tinyint")


def _melt(df: DataFrame, columns: list[str], name: str = "col_name", value: str = "value") -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[null_if_nan(F.col(c), types[c]).cast("string").alias(c) for c in columns]).unpivot([], columns, name, value)


def missing_share(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """col_name, missing_pct, most missing first. Null and NaN count; an empty table gives null shares."""
    types, columns = dict(df.dtypes), subset or df.columns
    row = df.agg(*[F.avg(missing(F.col(c), types[c]).cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "col_name", "missing_pct").orderBy(F.desc("missing_pct"), "col_name")


def missing_filter(df: DataFrame, threshold: float, subset: list[str] | None = None) -> DataFrame:
    """Without the columns that are missing in a share of the threshold or more."""
    return df.drop(*[r["col_name"] for r in missing_share(df, subset).filter(F.col("missing_pct") >= threshold).collect()])


def const_share(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """col_name, const_pct: the commonest value's share of the values that aren't null; 1 for a column of nulls."""
    columns = subset or df.columns
    counts = _melt(df, columns).groupBy("col_name", "value").agg(F.count("value").alias("n"))
    return counts.groupBy("col_name").agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(1.0)).alias("const_pct"))


def const_filter(df: DataFrame, threshold: float, subset: list[str] | None = None) -> DataFrame:
    return df.drop(*[r["col_name"] for r in const_share(df, subset).filter(F.col("const_pct") >= threshold).collect()])


def deviation(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """col_name, std: sample deviations of the numeric columns."""
    types = dict(df.dtypes)
    columns = [c for c in subset or df.columns if types[c] in NUMBERS]
    row = df.agg(*[F.stddev_samp(null_if_nan(F.col(c), types[c]).cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "col_name", "std")


def var_filter(df: DataFrame, threshold: float, subset: list[str] | None = None) -> DataFrame:
    return df.drop(*[r["col_name"] for r in deviation(df, subset).filter(F.col("std") <= threshold).collect()])


def clean_types(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Text columns are trimmed; one whose values all parse as numbers becomes a double. Nulls are ignored; a column of nulls stays text."""
    texts = [c for c, t in df.dtypes if t == "string" and (subset is None or c in subset)]
    if not texts:
        return df
    odd = df.agg(*[F.count_if(F.col(c).isNotNull() & as_double(F.col(c)).isNull()).alias(c) for c in texts], *[F.count(c).alias(f"__n_{c}") for c in texts]).first()
    return df.withColumns({c: as_double(F.col(c)) if odd[c] == 0 and odd[f"__n_{c}"] else F.trim(F.col(c)) for c in texts})


def feature_classes(df: DataFrame, threshold: int, subset: list[str] | None = None) -> DataFrame:
    """col_name, n_distinct (null counts as a value), feature_class: 'cat' (text or number, at most threshold values), 'num' (number, more), 'res' (the rest). An empty table has 0 values."""
    types, columns = dict(df.dtypes), subset or df.columns
    # values are grouped before they are counted, so no task holds a column's distinct values; adding 0 makes the two zeros one
    plain = [(F.col(c) + F.lit(0).cast(types[c]) if types[c] in ("double", "float") else F.col(c)).cast("string").alias(c) for c in columns]
    counts = df.select(*plain).unpivot([], columns, "col_name", "value").groupBy("col_name", "value").agg(F.lit(1).alias("one")).groupBy("col_name").agg(F.count("*").alias("n"))
    kinds = [(c, "string" if types[c] == "string" else "number" if types[c] in ("bigint", "double") else "other") for c in columns]
    every = df.sparkSession.createDataFrame(kinds, "col_name string, kind string").join(counts, "col_name", "left").select("col_name", "kind", F.coalesce("n", F.lit(0)).alias("n_distinct"))
    few, kind = F.col("n_distinct") <= threshold, F.col("kind")
    named = F.when((kind != "other") & few, "cat").when(kind == "number", "num").otherwise("res")
    return every.select("col_name", "n_distinct", named.alias("feature_class"))


def merge_categories(df: DataFrame, col: str, threshold: int, tag: str = "OTHER") -> DataFrame:
    """Values with fewer rows than the threshold become the tag; null stays null.

    Values are counted, then joined back; Spark broadcasts the counts only if their measured size is small."""
    rare = df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    joined = df.join(rare, F.col(col) == F.col("__v"), "left")
    return joined.withColumn(col, F.when(F.col(col).isNotNull(), F.when(F.col("__n") < threshold, F.lit(tag)).otherwise(F.col(col)))).drop("__v", "__n")
