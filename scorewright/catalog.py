"""Registered queries of the analytics part, each with its SQL equivalent for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright import jvm
from scorewright.functions import expressions as X
from scorewright.operators import binning, boosting, evaluate, models, neural, profile, relational, scorecard, sequence, text, training, trees
from scorewright.plans import features, lineage, sqlgen
from scorewright.plans.panes import Panes
from scorewright.plans.specs import FeatureSpec, TableSpec
from scorewright.session import cut, shared_folder
from scorewright.shipping import ship
from scorewright.sources import readers, writers
from scorewright.streaming.features import windowed_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to few digits: sums of floats differ in their last bits with the order of rows."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])  # no negative zeros


def rounded_sql(sql: str, columns: list[str], keys: list[str], digits: int = 6) -> str:
    return f"SELECT {', '.join([*keys, *(f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in columns)])} FROM ({sql}) t"


# -- generated features ---------------------------------------------------------------------------------------------

STATUS = ("o_orderstatus", tuple((f"COL='{s}'", f"status {s}", s.lower()) for s in "FOP"))
PRIORITY = ("o_orderpriority", (("COL='1-URGENT'", "urgent", "urg"), ("COL<>'1-URGENT'", "others", "oth")))


def _spec(tag: str, functions: list[str], conditions=(STATUS,), objects=("o_totalprice",)) -> list[FeatureSpec]:
    return [FeatureSpec.from_dict({"tag": tag, "objects": objects, "function": functions, "condition_cols": conditions})]


FLAGSHIP = _spec("ORD", ["COUNT", "SUM", "MAXABS"])
NORMAL = _spec("N", ["SUM", "AVG", "MAX", "MIN", "STD", "COUNT", "CNT", "CNTDIST", "SUMABS", "MAXABS", "MINABS", "AVGABS"])
MEDIAN = _spec("M", ["MID"])
SKEW = _spec("K", ["SKEW"], ())
RATIO = _spec("P", ["PCTSUM_O_ORDERSTATUS", "PCTCNT_O_ORDERPRIORITY", "PCTCNTDIST_O_ORDERSTATUS"], (STATUS, PRIORITY))
EVENTS = TableSpec.from_dict({"database": "d", "table": ("events", ""), "entitys": [("user_id", "bigint", "")], "dimensions": [("event_type", "string", ""), ("value", "double", "")], "winpos_col": [("days", "int", "")], "win_nm": ["w1", "w2"]})
WINDOWED = [FeatureSpec.from_dict({"tag": "E", "objects": ["value"], "function": ["SUM", "COUNT", "PCTCNT_DAYS"], "condition_cols": [("days", [("COL<=7", "a week", "d7"), ("COL<=30", "a month", "d30")])]})]


def _feature_query(name: str, specs: list[FeatureSpec], entity: list[str], source: str) -> None:
    sql, aliases = sqlgen.feature_sql(specs, entity, source, dialect="duckdb")
    query(name, rounded_sql(sql, aliases, entity))(lambda spark, sf_dir: rounded(_as_double(features.compute(table(spark, sf_dir, source), specs, entity), entity)))
    SQL[name] = SQL[name].replace("round(", "round(1.0::DOUBLE * ")


def _as_double(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in keys])


_feature_query("flagship", FLAGSHIP, ["o_custkey"], "orders")
_feature_query("feat_normal", NORMAL, ["o_custkey"], "orders")
_feature_query("feat_median", MEDIAN, ["o_custkey"], "orders")
_feature_query("feat_skew", SKEW, ["o_custkey"], "orders")
_feature_query("feat_pct", RATIO, ["o_custkey"], "orders")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max(F.to_date("ts")).alias("asof"))  # one row
    return sequence.window_columns(events.crossJoin(F.broadcast(last)), ["days"], F.col("ts"), {"w1": F.col("asof"), "w2": F.date_sub("asof", 7)})


_WINDOW_SQL, _WINDOW_ALIASES = sqlgen.feature_sql(WINDOWED, ["user_id"], "e", EVENTS, "w1", "duckdb")


@query("feat_window", rounded_sql(_WINDOW_SQL.replace("from e\n", "from (SELECT *, datediff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) AS days_w1 FROM events) e\n"), _WINDOW_ALIASES, ["user_id"]).replace("round(", "round(1.0::DOUBLE * "))
def feat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_as_double(features.compute(_events(spark, sf_dir), WINDOWED, ["user_id"], EVENTS, "w1"), ["user_id"]))


def _panes_sql() -> str:
    """Both windows by aggregations over all rows, a part each."""
    parts = []
    for w, back in (("w1", 0), ("w2", 7)):
        sql, aliases = sqlgen.feature_sql(WINDOWED, ["user_id"], "e", EVENTS, w, "duckdb")
        source = f"from (SELECT *, datediff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) - {back} FROM events)) AS days_{w} FROM events) e\n"
        parts.append(f"SELECT user_id, '{w}' AS window, {', '.join(f'round(1.0::DOUBLE * {a}, 6) + 0.0::DOUBLE AS {a}' for a in aliases)} FROM ({sql.replace('from e' + chr(10), source)}) t")
    return " UNION ALL ".join(parts)


@query("feat_panes", _panes_sql())
def feat_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of a spec from daily panes."""
    events = table(spark, sf_dir, "events")
    panes = Panes(spark, _folder(spark, "panes"), WINDOWED, ["user_id"], EVENTS, "ts")
    panes.append(events)
    last = events.agg(F.max(F.to_date("ts"))).first()[0]
    found = panes.compute({"w1": F.lit(last), "w2": F.date_sub(F.lit(last), 7)})
    return rounded(_as_double(found, ["user_id", "window"]))


@query("feat_sql_text", SQL["flagship"])
def feat_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features from the rendered SQL text instead of Columns."""
    sql, _ = sqlgen.feature_sql(FLAGSHIP, ["o_custkey"], "{orders}")
    return rounded(_as_double(spark.sql(sql, orders=table(spark, sf_dir, "orders")), ["o_custkey"]))


# -- relational shapes ----------------------------------------------------------------------------------------------


@query("top1_per_key", """
SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS rn
  FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'A' AND CAST(l_shipdate AS DATE) <= DATE '2000-08-31') t WHERE rn = 1""")  # fmt: skip
def top1_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 10) & (F.col("l_returnflag") == "A") & (F.to_date("l_shipdate") <= F.lit("2000-08-31").cast("date")))
    best = relational.top_per_key(rows, ["l_orderkey"], [F.desc("l_extendedprice"), *map(F.col, ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))])
    return best.select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")


def _branch(flag: str) -> str:
    return f"""SELECT o_custkey, datediff('day', CAST(CAST(o_orderdate AS DATE) + to_months(l_linenumber - 1) AS DATE), CAST(l_shipdate AS DATE)) AS due_days
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS rn FROM lineitem WHERE l_returnflag = '{flag}') w
  JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1"""


@query("overdue_union", "SELECT o_custkey, CAST(max(due_days) AS INTEGER) AS due_days FROM (" + " UNION ALL ".join(map(_branch, "ANR")) + ") t WHERE due_days > 3 GROUP BY o_custkey")
def overdue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")

    def branch(flag: str) -> DataFrame:
        order = [F.desc("l_extendedprice"), *map(F.col, ("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))]
        best = relational.top_per_key(lines.filter(F.col("l_returnflag") == flag), ["l_orderkey"], order)
        days = relational.due_days(F.col("l_shipdate"), F.col("o_orderdate"), F.col("l_linenumber") - 1)
        return best.join(orders, best.l_orderkey == orders.o_orderkey).select("o_custkey", days.alias("due_days"))

    return relational.overdue([branch(f) for f in "ANR"], "o_custkey", 3)


@query("explode_distinct", """
WITH e AS (SELECT p_size, p_brand, p_retailprice, p_partkey, unnest(string_split(p_name, ' ')) AS period FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey, period) AS rn FROM e),
c AS (SELECT p_size, p_brand, count(DISTINCT period) AS n, count(DISTINCT period) * sum(CASE WHEN rn = 1 THEN p_retailprice ELSE 0 END) AS amt, max(p_partkey) AS paid FROM r GROUP BY ALL)
SELECT p_size, max(paid) AS last_payment_due_date, CAST(sum(n) AS BIGINT) AS ovd_times, round(sum(amt), 2) AS ovd_total_amt FROM c GROUP BY p_size""")  # fmt: skip
def explode_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return rounded(relational.times_amount(part, "p_size", "p_brand", F.split("p_name", " "), "p_retailprice", "p_partkey", [F.col("p_partkey")]), 2)


@query("left_chain", """
SELECT r_name, CAST(max(o_totalprice) AS DOUBLE) AS top_price, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR) LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")  # fmt: skip
def left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = relational.left_chain(orders, [
        (customer, F.col("o_custkey").cast("string") == F.col("c_custkey").cast("string")),
        (nation, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("n_nationkey") != 3)),
        (region, F.col("n_regionkey") == F.col("r_regionkey")),
    ])
    return joined.groupBy("r_name").agg(F.max("o_totalprice").alias("top_price"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("full_outer_fill", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS orders_n, coalesce(b.n, 0) AS customers_n
FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k""")  # fmt: skip
def full_outer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and rows of each customer key, with 0 where one of the tables doesn't have it."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders_n"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("customers_n"))
    return a.join(b, "k", "full_outer").na.fill(0, ["orders_n", "customers_n"])


@query("map_values", "SELECT c_custkey, CASE n_name WHEN NULL THEN 'none' ELSE coalesce(n_name, 'none') END AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return relational.map_values(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "n_name", F.lit("none"))


@query("keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) t WHERE rn = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("safe_casts", """
SELECT p_partkey, CASE WHEN p_name LIKE '%e%' THEN TRY_CAST(string_split(p_brand, '#')[2] AS INTEGER) ELSE TRY_CAST(p_brand AS INTEGER) END AS number,
  p_retailprice / nullif(p_size % 5, 0) AS ratio FROM part""")
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that isn't a number and ratios over zero are null, not errors."""
    number = F.when(F.col("p_name").like("%e%"), F.get(F.split("p_brand", "#"), F.lit(1))).otherwise(F.col("p_brand")).try_cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), F.try_divide("p_retailprice", F.col("p_size") % 5).alias("ratio"))


# -- sequences ------------------------------------------------------------------------------------------------------


@query("seq_corr", "SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity_l_extendedprice FROM lineitem GROUP BY l_suppkey")
def seq_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.correlation(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"))


@query("seq_regr", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS rega_l_quantity_l_extendedprice, round(regr_intercept(l_extendedprice, l_quantity), 4) AS regb_l_quantity_l_extendedprice FROM lineitem GROUP BY l_suppkey")
def seq_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.linear_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), 4)


@query("seq_change", "SELECT user_id, round(avg(d), 6) AS change_value FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) t GROUP BY user_id")
def seq_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.average_change(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query("seq_features", """
WITH d AS (SELECT *, l_extendedprice - lag(l_extendedprice) OVER w AS price_change, l_tax - lag(l_tax) OVER w AS tax_change FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax))
SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 4) AS corr_l_quantity_l_extendedprice, round(corr(l_tax, l_discount), 4) AS corr_l_tax_l_discount,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS rega_l_quantity_l_extendedprice, round(regr_intercept(l_extendedprice, l_quantity), 4) AS regb_l_quantity_l_extendedprice,
  round(regr_slope(l_extendedprice, l_tax), 4) AS rega_l_tax_l_extendedprice, round(regr_intercept(l_extendedprice, l_tax), 4) AS regb_l_tax_l_extendedprice,
  round(avg(price_change), 4) AS change_l_extendedprice, round(avg(tax_change), 4) AS change_l_tax FROM d GROUP BY l_suppkey""")
def seq_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several correlations, fits of one column over two others, and mean changes, in one aggregation."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax"]
    pairs = [("l_quantity", "l_extendedprice"), ("l_tax", "l_discount")], [("l_quantity", "l_extendedprice"), ("l_tax", "l_extendedprice")]
    return rounded(sequence.sequence_features(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, *pairs, ["l_extendedprice", "l_tax"]), 4)


@query("stream_windows", """
SELECT CAST(ts AS DATE) AS day, event_type, round(sum(value), 6) + 0.0::DOUBLE AS total, count(value) AS n FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed features that also run on a stream, here over the whole table."""
    found = windowed_features(table(spark, sf_dir, "events"), [FeatureSpec("E", ("value",), ("SUM", "COUNT"))], ["event_type"], "ts", "1 day")
    return rounded(found.select(F.to_date("window_start").alias("day"), "event_type", F.col("E__SUM__value").alias("total"), F.col("E__COUNT__value").alias("n")))


# -- profiling ------------------------------------------------------------------------------------------------------

_HOLES = "SELECT l_orderkey, nullif(l_returnflag, 'N') AS flag, nullif(l_linestatus, 'O') AS status, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS quantity FROM lineitem"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.nullif("l_linestatus", F.lit("O")).alias("status"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("quantity"))


_HOLED = ["flag", "status", "quantity"]


@query("missing", " UNION ALL ".join(f"SELECT '{c}' AS col_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_pct FROM ({_HOLES}) t" for c in _HOLED))
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.missing_share(_holes(spark, sf_dir), _HOLED))


@query("const_share", " UNION ALL ".join(f"SELECT '{c}' AS col_name, round(max(n) / sum(n)::DOUBLE, 6) AS const_pct FROM (SELECT {c}, count({c}) AS n FROM ({_HOLES}) t GROUP BY 1) g" for c in _HOLED))
def const_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.const_share(_holes(spark, sf_dir), _HOLED))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("var_share", " UNION ALL ".join(f"SELECT '{c}' AS col_name, round(stddev_samp({c}), 4) AS std FROM lineitem" for c in _NUMERIC))
def var_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.deviation(table(spark, sf_dir, "lineitem"), _NUMERIC), 4)


@query("feature_class", " UNION ALL ".join(f"SELECT '{c}' AS col_name, n_distinct, CASE WHEN n_distinct <= 10 THEN 'cat' ELSE '{big}' END AS feature_class FROM (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM ({_HOLES}) t) g" for c, big in (("l_orderkey", "num"), ("flag", "res"), ("status", "res"), ("quantity", "num"))))
def feature_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feature_classes(_holes(spark, sf_dir), 10)


@query("clean_types", "SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS number, trim(p_name) AS name FROM part")
def clean_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return profile.clean_types(part.select("p_partkey", F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("number"), F.concat("p_name", F.lit("  ")).alias("name")))


@query("column_filters", f"SELECT l_orderkey, quantity FROM ({_HOLES}) t")
def column_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, constant and variance filters one after the other, over the whole table; status, which has one value left, goes."""
    df = _holes(spark, sf_dir).withColumn("one", F.lit(1.0)).withColumn("none", F.lit(None).cast("double"))
    return profile.var_filter(profile.const_filter(profile.missing_filter(df, 0.9), 1.0).drop("flag"), 0.0, ["quantity"])


@query("category_merge", "SELECT p_partkey, CASE WHEN p_brand IS NULL THEN NULL WHEN n < 80 THEN 'OTHER' ELSE p_brand END AS p_brand FROM part JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) c ON b = p_brand")
def category_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.merge_categories(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 80)


# -- binning and scorecard ------------------------------------------------------------------------------------------


@query("qcut_bins", """
WITH q AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM customer)
SELECT c_custkey, CAST(len(list_filter(cuts, lambda c: c < c_acctbal)) AS INTEGER) AS bin FROM customer, q""")
def qcut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.cut(table(spark, sf_dir, "customer"), "c_acctbal", "qcut", 10)[0].select("c_custkey", "bin")


@query("wcut_bins", """
WITH q AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, CAST(len(list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: lo + i * (hi - lo) / 8 < c_acctbal)) AS INTEGER) AS bin FROM customer, q""")
def wcut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.cut(table(spark, sf_dir, "customer"), "c_acctbal", "wcut", 8)[0].select("c_custkey", "bin")


_LABELLED = "SELECT * FROM documents JOIN labels USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts, with their labels."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query("crosstab", f"SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM ({_LABELLED}) t GROUP BY lang")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.crosstab(_labelled(spark, sf_dir), "lang", "quality", [0, 1]).select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))


@query("chi2_2x2", f"""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b,
  count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM ({_LABELLED}) t)
SELECT round((a + b + c + d) * pow(greatest(abs(1.0 * a * d - b * c) - (a + b + c + d) / 2.0, 0), 2) / nullif(1.0 * (a + b) * (c + d) * (a + c) * (b + d), 0), 6) AS chi2 FROM c""")
def chi2_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    row = _labelled(spark, sf_dir).agg(*[F.count_if(x).cast("double").alias(n) for n, x in zip("abcd", (q & t, q & ~t, ~q & t, ~q & ~t), strict=True)])
    return row.select(F.round(X.yates_chi2(*map(F.col, "abcd")), 6).alias("chi2"))


@query("woe", f"""
WITH c AS (SELECT lang AS bin, count(*) FILTER (quality = 1) AS g, count(*) FILTER (quality <> 1) AS b FROM ({_LABELLED}) t GROUP BY 1)
SELECT bin, round(ln(((g + 1) / (b + 1)) / ((SELECT sum(g) FROM c) / (SELECT sum(b) FROM c))), 6) AS woe FROM c""")
def woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.woe(_labelled(spark, sf_dir), "lang", "quality"))


@query("iv", f"""
WITH d AS ({_LABELLED}), n AS (SELECT source AS s, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT CASE WHEN n < 20 THEN 'OTHER' ELSE source END AS bin, 1.0 + count(*) FILTER (quality = 1) AS g, 1.0 + count(*) FILTER (quality <> 1) AS b FROM d JOIN n ON s = source GROUP BY 1),
a AS (SELECT sum(g - 1) + 1 AS ga, sum(b - 1) + 1 AS ba FROM c)
SELECT 'source' AS col_name, round(sum((b / ba - g / ga) * ln((b::DOUBLE / g) / (ba::DOUBLE / ga))), 6) AS iv FROM c, a""")
def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.information_value(_labelled(spark, sf_dir), "source", "quality", rare=20))


@query("woe_encode", f"""
WITH d AS ({_LABELLED}), c AS (SELECT lang AS bin, count(*) FILTER (quality = 1) AS g, count(*) FILTER (quality <> 1) AS b FROM d GROUP BY 1)
SELECT doc_id, round(ln(((g + 1) / (b + 1)) / ((SELECT sum(g) FROM c) / (SELECT sum(b) FROM c))), 6) AS lang_woe FROM d JOIN c ON lang = bin""")
def woe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.woe_encode(_labelled(spark, sf_dir), "lang", "quality").select("doc_id", "lang_woe"))


@query("cust_bins", "SELECT c_custkey, CAST(CASE WHEN c_acctbal <= 0 THEN 0 WHEN c_acctbal <= 2500 THEN 1 WHEN c_acctbal <= 7000 THEN 2 ELSE 3 END AS INTEGER) AS bin FROM customer")
def cust_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.cut(table(spark, sf_dir, "customer"), "c_acctbal", "cust", cut_points=[float("-inf"), 7000, 0, 2500, 2500, float("inf")])[0].select("c_custkey", "bin")


def _psi_sql(part: str) -> str:
    return f"""SELECT 'o_totalprice' AS col_name, CAST(len(list_filter(cuts, lambda c: c < o_totalprice)) AS VARCHAR) AS bin FROM {part}, cuts
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM {part}"""


@query("psi", f"""
WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), te AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
cuts AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM tr),
a AS (SELECT col_name, bin, count(*) AS a FROM ({_psi_sql("tr")}) x GROUP BY ALL), b AS (SELECT col_name, bin, count(*) AS b FROM ({_psi_sql("te")}) x GROUP BY ALL),
j AS (SELECT col_name, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL OUTER JOIN b USING (col_name, bin)),
p AS (SELECT col_name, (a + 1) / sum(a) OVER w AS p, (b + 1) / sum(b) OVER w AS q FROM j WINDOW w AS (PARTITION BY col_name))
SELECT col_name, round(sum((p - q) * ln(p / q)), 6) AS psi FROM p GROUP BY col_name""")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, edge = table(spark, sf_dir, "orders"), F.lit("1999-01-01").cast("timestamp_ntz")
    train, test = (orders.filter(x) for x in (F.col("o_orderdate") < edge, F.col("o_orderdate") >= edge))
    return rounded(scorecard.psi(train, test, ["o_orderpriority"], ["o_totalprice"]))


@query("vif", """
WITH g AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem)
SELECT unnest(['l_quantity', 'l_extendedprice']) AS col_name, round(xx * yy / (xx * yy - xy * xy), 6) AS vif FROM g""")
def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem" for i, x in enumerate(_NUMERIC) for y in _NUMERIC[i + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.correlations(table(spark, sf_dir, "lineitem"), _NUMERIC))


@query("ttest", "SELECT count(c_acctbal) AS n, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))), 6) AS t, count(c_acctbal) - 1 AS dof, round(avg(c_acctbal) - 4500, 6) AS diff, round(stddev_samp(c_acctbal), 6) AS std FROM customer")
def ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.t_test(table(spark, sf_dir, "customer"), "c_acctbal", 4500.0))


@query("chi2_tests", """
WITH v AS (SELECT 'l_linestatus' AS col_name, l_linestatus AS v, l_returnflag AS t FROM lineitem UNION ALL SELECT 'even', CASE WHEN l_partkey % 2 = 0 THEN 'yes' ELSE 'no' END, l_returnflag FROM lineitem),
c AS (SELECT col_name, v, t, count(*)::DOUBLE AS n FROM v GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY col_name, v) * sum(n) OVER (PARTITION BY col_name, t) / sum(n) OVER (PARTITION BY col_name) AS e FROM c),
s AS (SELECT col_name, sum((n - e) * (n - e) / e) AS chi2 FROM e GROUP BY col_name)
SELECT col_name, round(chi2, 6) + 0.0::DOUBLE AS chi2, 2 AS dof, round(exp(-chi2 / 2), 6) + 0.0::DOUBLE AS p FROM s""")
def chi2_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns against a target of three classes; with two degrees of freedom the tail is exp(-x / 2)."""
    lines = table(spark, sf_dir, "lineitem").withColumn("even", F.when(F.col("l_partkey") % 2 == 0, "yes").otherwise("no"))
    return rounded(scorecard.chi2_tests(lines, ["l_linestatus", "even"], "l_returnflag"))


@query("t_tests")
def t_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scorecard.t_tests(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 25.0, ["l_returnflag"]))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("iv_all", f"""
WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS DOUBLE) AS x, l_returnflag = 'R' AS good FROM lineitem" for c in _NUMBERS)}),
q AS (SELECT col_name, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts, max(x) AS top FROM v GROUP BY col_name),
b AS (SELECT col_name, len(list_filter(cuts, lambda c: c < x AND c < top)) AS bin, good FROM v JOIN q USING (col_name)),
c AS (SELECT col_name, bin, count(*) FILTER (good) + 1.0 AS g, count(*) FILTER (NOT good) + 1.0 AS b FROM b GROUP BY col_name, bin),
t AS (SELECT *, sum(g - 1) OVER (PARTITION BY col_name) + 1 AS ga, sum(b - 1) OVER (PARTITION BY col_name) + 1 AS ba FROM c)
SELECT col_name, round(sum((b / ba - g / ga) * ln((b / g) / (ba / ga))), 6) + 0.0::DOUBLE AS iv FROM t GROUP BY col_name""")
def iv_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information values of all columns of numbers of a table in one call."""
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(scorecard.information_values(lines, _NUMBERS, "y"))


def _chimerge_sql(source: str, columns: list[str], target: str, bins: int, start: int = 100) -> str:
    """Edges of columns of numbers against a target of 0 and 1: quantile bins, then a merge of the two neighbours that differ least, a round each."""
    shares = ", ".join(f"{i / start!r}" for i in range(1, start))
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS DOUBLE) AS x, CAST({target} AS DOUBLE) AS y FROM ({source}) t" for c in columns)
    a, b, c, d = "g[i][2]", "g[i][3]", "g[i + 1][2]", "g[i + 1][3]"
    n = f"({a} + {b} + {c} + {d})"
    cells = " + ".join(f"CASE WHEN ({row}) * ({col}) > 0 THEN 1 / (({row}) * ({col}) / {n}) ELSE 0 END" for row in (f"{a} + {b}", f"{c} + {d}") for col in (f"{a} + {c}", f"{b} + {d}"))
    gap = f"abs({a} * {d} - {b} * {c}) / {n}"
    return f"""WITH RECURSIVE v AS ({stacked}),
q AS (SELECT col_name, list_sort(list_distinct(quantile_cont(x, [{shares}]))) AS cuts, max(x) AS top FROM v GROUP BY col_name),
e AS (SELECT col_name, list_filter(cuts, lambda c: c < top) AS cuts FROM q),
k AS (SELECT col_name, len(list_filter(cuts, lambda c: c < x)) AS bin, y, cuts FROM v JOIN e USING (col_name) WHERE x IS NOT NULL),
f AS (SELECT col_name, bin, any_value(cuts) AS cuts, sum(1 - y) AS bad, sum(y) AS good FROM k GROUP BY col_name, bin),
r AS (SELECT col_name, any_value(cuts) AS cuts, list([CAST(bin AS DOUBLE), bad, good] ORDER BY bin) AS g FROM f GROUP BY col_name
  UNION ALL SELECT col_name, cuts, list_concat(list_concat(g[:place - 1], [[g[place + 1][1], g[place][2] + g[place + 1][2], g[place][3] + g[place + 1][3]]]), g[place + 2:])
  FROM (SELECT *, list_position(w, list_min(w)) AS place FROM (SELECT *, list_transform(range(1, len(g)), lambda i: ({gap} - least(0.5, {gap})) * ({gap} - least(0.5, {gap})) * ({cells})) AS w FROM r WHERE len(g) > {bins}) x) y),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY col_name ORDER BY len(g)) = 1)
SELECT col_name, unnest(list_transform(g[:-2], lambda b: round(cuts[CAST(b[1] AS INTEGER) + 1], 6))) AS cut FROM z"""


@query("chimerge_num", _chimerge_sql("SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)", ["n_chars"], "quality", 5))
def chimerge_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_cuts(_labelled(spark, sf_dir), ["n_chars"], "quality", 5)


@query("chimerge_all", _chimerge_sql("SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", 6))
def chimerge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of numbers of a table in one call."""
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return _merged_cuts(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y", 6)


def _merged_cuts(df: DataFrame, columns: list[str], target: str, bins: int) -> DataFrame:
    found = binning.chimerge_columns(df, columns, target, bins)
    return rounded(found.select("col_name", F.explode("cuts").alias("cut")))


@query("chimerge_cat")
def chimerge_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.chimerge_categories(_labelled(spark, sf_dir), "source", "quality", 4, rare=20)


@query("feature_selection")
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the VIF filter and the correlation filter keep."""
    lines = table(spark, sf_dir, "lineitem").withColumn("double_price", F.col("l_extendedprice") * 2 + F.col("l_tax"))
    columns = [*_NUMERIC, "double_price"]
    kept = scorecard.corr_filter(lines, columns, 0.8, dict(zip(columns, (0.1, 0.5, 0.2, 0.3, 0.4), strict=True)))
    small = scorecard.vif_filter(lines, columns)
    return spark.createDataFrame([(c, c in kept, c in small) for c in columns], "col_name string, corr_kept boolean, vif_kept boolean")


# -- evaluation -----------------------------------------------------------------------------------------------------

_CURVE = f"""c AS (SELECT CAST(n_chars AS DOUBLE) AS score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM ({_LABELLED}) t GROUP BY 1),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", f"WITH {_CURVE} SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM r")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc_curve(_labelled(spark, sf_dir), "n_chars", "quality").select("score", "fpr", "tpr"))


@query("roc_auc", f"WITH {_CURVE} SELECT round(sum(neg * (tp - pos / 2.0))::DOUBLE / max(p * n)::DOUBLE, 6) AS auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc(_labelled(spark, sf_dir), "n_chars", "quality"))


@query("ks", f"WITH {_CURVE} SELECT round(max(tp / p - fp / n), 6) AS ks FROM r")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ks(_labelled(spark, sf_dir), "n_chars", "quality"))


@query("pr_f1", f"WITH {_CURVE} SELECT round(max(2 * tp / (p + tp + fp)), 6) AS max_f1 FROM r WHERE tp > 0")
def pr_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.max_f1(_labelled(spark, sf_dir), "n_chars", "quality"))


@query("pr_real", f"WITH {_CURVE} SELECT score, round(tp / p, 6) AS recall, round((tp / p * 0.05) / nullif(fp / n + tp / p * 0.05, 0), 6) AS prec_real FROM r")
def pr_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.real_pr_curve(_labelled(spark, sf_dir), "n_chars", "quality", 0.05))


@query("top_percent", f"""
WITH d AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk, count(*) OVER () AS n FROM ({_LABELLED}) t),
g AS (SELECT unnest(generate_series(1, 100)) AS pct)
SELECT CAST(pct AS INTEGER) AS pct, CAST(floor(pct * (SELECT max(n) FROM d) / 100) AS BIGINT) AS n,
  round((SELECT count(*) FROM d WHERE quality = 1 AND rk <= floor(pct * d.n / 100)) / nullif(floor(pct * (SELECT max(n) FROM d) / 100), 0), 6) AS prec FROM g""")
def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.top_percent(_labelled(spark, sf_dir), "n_chars", "quality", ["doc_id"]))


@query("reg_metrics", """
WITH f AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse FROM f""")
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.regression_metrics(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p")
    return m.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"))


@query("hist_by_label", f"""
WITH d AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS x FROM ({_LABELLED}) t),
q AS (SELECT label, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75 FROM d GROUP BY 1),
e AS (SELECT min(x) AS mn, max(x) AS mx FROM d), b AS (SELECT min(greatest(p25 - 3 * (p75 - p25), mn)) AS lo, max(least(p75 + 3 * (p75 - p25), mx)) AS hi FROM q, e),
k AS (SELECT label, CAST(CAST(least(greatest(ceil((x - lo) / ((hi - lo) / 49)), 1), 50) AS BIGINT) AS VARCHAR) AS bin FROM d, b)
SELECT label, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM k GROUP BY label, bin""")
def hist_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.histogram_by_label(_labelled(spark, sf_dir), "n_chars", "quality"))


@query("hist_category", f"SELECT quality AS label, lang AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM ({_LABELLED}) t GROUP BY quality, lang")
def hist_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.histogram_by_label(_labelled(spark, sf_dir), "lang", "quality", category=True))


@query("accuracy", f"SELECT round(avg(CASE WHEN (n_chars > 500) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ({_LABELLED}) t")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(_labelled(spark, sf_dir).withColumn("guess", (F.col("n_chars") > 500).cast("int")), "guess", "quality"))


# -- lineage --------------------------------------------------------------------------------------------------------

SCRIPT = """
-- three dependent tables; comments; and names in strings 'from nowhere'
create table mart.late stored as parquet as
select user_id, max(d) as d from (select * from ods.repay w1 where rn = 1) t1 inner join ods.loan t2 on t1.k = t2.k /* from ods.ghost */
union all select user_id, 1 from ods.repay_b group by user_id;
insert overwrite table mart.Total with c as (select * from mart.late) select * from c, ods.users u where extract(year from u.born) > 1990;
insert into mart.report select * from mart.total left join ods.users on 1 = 1;
select * from mart.report;
"""
_EDGES = "VALUES ('ods.repay', 'mart.late'), ('ods.loan', 'mart.late'), ('ods.repay_b', 'mart.late'), ('mart.late', 'mart.total'), ('ods.users', 'mart.total'), ('mart.total', 'mart.report'), ('ods.users', 'mart.report')"


@query("lineage_edges", f"SELECT * FROM ({_EDGES}) t(src, dst)")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edges(spark, SCRIPT)


@query("lineage_closure", f"WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) t(src, dst)), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.closure(lineage.edges(spark, SCRIPT))


@query("lineage_cypher", f"""
WITH e AS (SELECT * FROM ({_EDGES}) t(src, dst)), n AS (SELECT x, 'node_' || (row_number() OVER (ORDER BY x) - 1) AS k, chr(39) AS q FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) t),
a AS (SELECT string_agg('(' || k || ':table{{name:' || q || x || q || ',project_tag:' || q || 'demo' || q || '}})', ',' ORDER BY x) AS nodes FROM n),
b AS (SELECT string_agg('(' || s.k || ')-[:to]->(' || d.k || ')', ',' ORDER BY src, dst) AS links FROM e JOIN n s ON s.x = src JOIN n d ON d.x = dst)
SELECT 'create' || chr(10) || nodes || chr(10) || ',' || chr(10) || links || chr(10) || 'return ' || chr(39) || 'finished' || chr(39) AS cypher FROM a, b""")
def lineage_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(lineage.cypher(lineage.edges(spark, SCRIPT), "demo"),)], "cypher string")


@query("lineage_by_tag", f"SELECT src, dst, 'keep' AS project_tag FROM ({_EDGES}) t(src, dst)")
def lineage_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lineage.edges(spark, SCRIPT)
    return lineage.without_tag(lineage.tagged(edges, "keep").unionByName(lineage.tagged(edges, "drop")), "drop")


_DDL = """VALUES ('events', 'create table d.events (
user_id bigint comment {q}{q}
, event_type string comment {q}{q}
, value double comment {q}{q}
, days_w1 int comment {q}{q}
, days_w2 int comment {q}{q}
)
comment {q}{q}
stored as parquet
location
{q}events{q}
;
'), ('snapshot', 'create table d.snapshot (
user_id bigint comment {q}{q}
, event_type string comment {q}{q}
, value double comment {q}{q}
, asof date comment {q}day of the snapshot{q}
, days_w1 int comment {q}{q}
, days_w2 int comment {q}{q}
)
comment {q}{q}
partitioned by (
dt string comment {q}day{q}
)
clustered by (user_id)
into 8 buckets
stored as parquet
location
{q}snapshot{q}
;
')""".format(q=2 * "'")


@query("table_ddl", f"SELECT * FROM ({_DDL}) t(name, ddl)")
def table_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a flow table and of a snapshot table."""
    snapshot = replace(EVENTS, name="snapshot", snapshot_col=(("asof", "date", "day of the snapshot"),), partitioned_by=(("dt", "string", "day"),), clustered_by=("user_id",), bucket_num=8)
    return spark.createDataFrame([(t.name, sqlgen.table_ddl(t)) for t in (EVENTS, snapshot)], "name string, ddl string")


# -- sources and sinks: each writes a whole table and reads it back -------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headed CSV file, in order of its key, read with a schema."""
    path = _folder(spark, "csv")
    writers.write_submission(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey", path)
    return readers.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("csv_sample", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def csv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A modelling sample: its first two columns, and the fourth as the label; types are inferred."""
    path = _folder(spark, "sample")
    table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey", "l_discount").write.option("header", True).csv(path)
    df, _, _ = readers.read_sample(spark, path, features=2, label=3)
    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])


@query("phrases", "SELECT CAST(p_partkey AS VARCHAR) AS PhraseId, p_name || ' ' || p_brand AS Phrase FROM part")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "phrases")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("PhraseId"), F.concat_ws("   ", "p_name", "p_brand").alias("Phrase"))
    part.write.option("header", True).option("quote", "").csv(path, sep="\t")
    return readers.read_phrases(spark, path)


@query("word_vectors", "SELECT 'w' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "vectors")
    table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.col("embedding").cast("array<string>"), " "))).write.text(path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(readers.read_vectors(spark, path).select("word", F.size("vec").alias("dims"), total.alias("total")), 4)


@query("tagged_tokens", "SELECT CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS token, CASE pos WHEN 0 THEN 'key' ELSE 'brand' END AS tag FROM part, (VALUES (0), (1)) t(pos)")
def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tagged")
    table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" key\n"), "p_brand", F.lit(" brand\n"))).write.text(path)
    return readers.read_tagged(spark, path).select("pos", "token", "tag")


@query("stored_table", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalogue, made from a query and read by name."""
    name = f"customers_{uuid.uuid4().hex}"
    writers.create_table_as(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), name)
    found = cut(readers.read_table(spark, name))  # what was read outlives the table, which goes
    spark.sql(f"DROP TABLE {name}")
    return found


# -- text -----------------------------------------------------------------------------------------------------------

_VOCAB = "v AS (SELECT w AS word, row_number() OVER (ORDER BY w) + 1 AS idx FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) t)"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts, numbered from 2 in alphabetical order by a sort in ranges."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("line_no", F.monotonically_increasing_id())
    return text.vocabulary(cut(ordered))  # written once: three steps read the numbers


@query("token_index", f"""
WITH {_VOCAB}, t AS (SELECT conv_id, turn, unnest(string_split(lower(regexp_replace(text, ' +', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(lower(regexp_replace(text, ' +', ' ', 'g')), ' '), 1) AS pos FROM conversations)
SELECT conv_id * 1000 + turn AS id, CAST(count(*) AS INTEGER) AS n, CAST(sum(coalesce(idx, 0) * pos) AS BIGINT) AS checksum FROM t LEFT JOIN v ON w = word GROUP BY 1""")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _token_ids(spark, sf_dir)
    weighted = F.aggregate(F.transform("input_ids", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return ids.select("id", F.size("input_ids").alias("n"), weighted.alias("checksum"))


def _token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and input_ids of each turn."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split(F.lower(text.squeeze_blanks(F.col("text"))), " ").alias("tokens"))
    return text.index_tokens(rows, "id", "tokens", _vocabulary(spark, sf_dir))


_IDS = """i AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(lower(regexp_replace(text, ' +', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(lower(regexp_replace(text, ' +', ' ', 'g')), ' '), 1) AS pos FROM conversations),
t AS (SELECT id, list(coalesce(idx, 0) ORDER BY pos) AS ids FROM i LEFT JOIN v ON w = word GROUP BY id)"""


@query("vocabulary", f"WITH {_VOCAB} SELECT word, CAST(idx AS BIGINT) AS idx FROM v")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query("train_split", "SELECT doc_id, CAST('0x' || substr(md5('7/' || doc_id), 1, 8) AS BIGINT) < CAST(floor(0.7 * 4294967296) AS BIGINT) AS train FROM documents")
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = text.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


@query("pad", f"WITH {_VOCAB}, {_IDS} SELECT id, array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), greatest(40 - len(ids), 0), 0), ids[:40]), ',') AS padded FROM t")
def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids cut or padded on the left to 40."""
    return text.pad(_token_ids(spark, sf_dir), "input_ids", 40).select("id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("padded"))


@query("padded_batches", f"""
WITH {_VOCAB}, {_IDS}, r AS (SELECT id, ids, row_number() OVER (ORDER BY len(ids), id) - 1 AS rn, count(*) OVER () AS n FROM t),
b AS (SELECT id, ids, CAST(least(floor(rn / 64), greatest(floor(n / 64) - 1, 0)) AS BIGINT) AS batch_id FROM r),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM b)
SELECT id, batch_id, CAST(width AS INTEGER) AS width, CAST(width - len(ids) AS INTEGER) AS gap, CAST(list_sum(ids) AS BIGINT) AS total FROM m""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in batches by length, each padded to its longest row, in a seeded order of batches."""
    rows = _token_ids(spark, sf_dir).withColumn("n", F.size("input_ids"))
    batched = text.shuffle_batches(text.pad_batches(text.batches(rows, "n", 64, ["id"]), "batch_id", "input_ids"), "batch_id", 7)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return batched.select("id", "batch_id", F.size("input_ids").alias("width"), (F.size("input_ids") - F.col("n")).alias("gap"), total.alias("total"))


@query("batches", """
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(least(floor(rn / 100), greatest(floor(n / 100) - 1, 0)) AS BIGINT) AS batch_id FROM r""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 100, ["doc_id"]).select("doc_id", "batch_id")


@query("embed_lookup", f"""
WITH {_VOCAB}, {_IDS}, u AS (SELECT id, unnest(ids) AS idx FROM t), e AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)
SELECT id, count(*) AS n, round(sum(coalesce(s, 0)), 4) + 0.0::DOUBLE AS total FROM u LEFT JOIN e ON idx = vec_id GROUP BY id""")
def embed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each turn's token ids; ids without a vector get zeros."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    total = F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    found = text.embed(_token_ids(spark, sf_dir), "id", "input_ids", vectors, 64)
    return rounded(found.select("id", F.size("vectors").cast("long").alias("n"), total.alias("total")), 4)


@query("attention", """
WITH k AS (SELECT label, vec_id, embedding AS v FROM embeddings),
s AS (SELECT q.vec_id, q.label, k.v, exp(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(k.v AS DOUBLE[]))) AS w FROM k q JOIN k ON q.label = k.label)
SELECT vec_id, round(sum(w * v[1]) / sum(w), 6) AS first, round(sum(w * v[64]) / sum(w), 6) AS last FROM s GROUP BY vec_id""")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = neural.self_attention(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumnRenamed("id", "vec_id")
    return rounded(out.select("vec_id", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(63)).alias("last")))


_TRANSITIONS = [[0.5, -0.5, 0, 0.1], [0, 0.2, -0.1, 0], [0.3, 0, 0.1, -0.2], [0, 0.1, 0, 0.4]]
_RUN = 256  # ids of a sequence: the vectors of one label among them are its steps


def _through(state: str, tag: int) -> str:
    return f"[{', '.join(f'{state}[{k + 1}] + {x}' for k, x in enumerate(_TRANSITIONS[tag]))}]"


@query("viterbi", f"""
WITH RECURSIVE e AS (SELECT label, CAST(vec_id // {_RUN} AS BIGINT) AS run, row_number() OVER (PARTITION BY label, vec_id // {_RUN} ORDER BY vec_id) AS t,
  [{", ".join(f"list_sum(CAST(embedding[{16 * k + 1}:{16 * k + 16}] AS DOUBLE[])) / 8" for k in range(4))}] AS e FROM embeddings),
r AS (SELECT label, run, t, e AS s, e AS z, ['0', '1', '2', '3'] AS p FROM e WHERE t = 1
  UNION ALL SELECT label, run, t, [{", ".join(f"list_max(s{k}) + e[{k + 1}]" for k in range(4))}],
    [{", ".join(f"list_max(z{k}) + ln(list_sum(list_transform(z{k}, lambda x: exp(x - list_max(z{k}))))) + e[{k + 1}]" for k in range(4))}],
    [{", ".join(f"p[list_position(s{k}, list_max(s{k}))] || '{k}'" for k in range(4))}]
  FROM (SELECT r.label, r.run, e.t, e.e, p, {", ".join(f"{_through('s', k)} AS s{k}, {_through('z', k)} AS z{k}" for k in range(4))}
    FROM r JOIN e ON r.label = e.label AND r.run = e.run AND e.t = r.t + 1) x)
SELECT label, run, round(list_max(s), 6) AS score, p[list_position(s, list_max(s))] AS path, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) AS log_z
FROM r QUALIFY row_number() OVER (PARTITION BY label, run ORDER BY t DESC) = 1""")
def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best tag paths over sequences of vectors; sums of four quarters of a vector are the emissions of four tags."""
    import numpy as np

    ship(spark)
    transitions = np.array(_TRANSITIONS)
    step = neural.dense_udf([(np.kron(np.eye(4), np.ones(16)) / 8, np.zeros(4))])("embedding")
    rows = _sequences(table(spark, sf_dir, "embeddings").select("label", "vec_id", step.alias("e")))
    best = rows.select("label", "run", neural.viterbi_udf(transitions)("steps").alias("best"), neural.log_partition_udf(transitions)("steps").alias("log_z"))
    return rounded(best.select("label", "run", "best.score", F.array_join("best.path", "").alias("path"), "log_z"))


def _sequences(vectors: DataFrame) -> DataFrame:
    """label, run, steps: vectors `e` in the order of their ids, 256 at most in a sequence."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "e"))), lambda p: p["e"])
    return vectors.groupBy("label", F.floor(F.col("vec_id") / _RUN).alias("run")).agg(steps.alias("steps"))


@query("log_sum_exp", "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))), 6) AS lse, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings")
def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", X.log_sum_exp(x).alias("lse"), X.argmax(x).alias("top")))


@query("crf_loss", f"""
WITH RECURSIVE e AS (SELECT label, CAST(vec_id // {_RUN} AS BIGINT) AS run, CAST(vec_id % 4 AS INTEGER) AS tag, row_number() OVER (PARTITION BY label, vec_id // {_RUN} ORDER BY vec_id) AS t,
  [{", ".join(f"list_sum(CAST(embedding[{16 * k + 1}:{16 * k + 16}] AS DOUBLE[])) / 8" for k in range(4))}] AS e FROM embeddings),
m AS (SELECT {_TRANSITIONS}::DOUBLE[][] AS m),
r AS (SELECT label, run, t, tag, e AS z, e[tag + 1] AS gold FROM e WHERE t = 1
  UNION ALL SELECT label, run, t, tag, [{", ".join(f"list_max(z{k}) + ln(list_sum(list_transform(z{k}, lambda x: exp(x - list_max(z{k}))))) + e[{k + 1}]" for k in range(4))}], gold
  FROM (SELECT r.label, r.run, e.t, e.tag, e.e, gold + e.e[e.tag + 1] + m.m[e.tag + 1][r.tag + 1] AS gold, {", ".join(f"{_through('z', k)} AS z{k}" for k in range(4))}
    FROM r JOIN e ON r.label = e.label AND r.run = e.run AND e.t = r.t + 1 CROSS JOIN m) x)
SELECT label, run, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - gold, 5) AS loss FROM r QUALIFY row_number() OVER (PARTITION BY label, run ORDER BY t DESC) = 1""")
def crf_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log-likelihood of given tags (the ids' remainders by 4) over sequences of vectors, padded to batches."""
    import numpy as np

    weights = np.kron(np.eye(4), np.ones(16)) / 8
    net = training.SequenceNet(64, 4, "crf", layers=0, two_way=False, parts={"out.W": weights, "out.b": np.zeros(4), "moves": np.array(_TRANSITIONS, float), "start": np.zeros(4), "stop": np.zeros(4)})
    found = training.losses(net, _tagged(spark, sf_dir), "steps", "tags", ["label", "run"])
    return rounded(found.select("label", "run", "loss"), 5)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of vectors with the remainders of their ids as tags."""
    e = F.struct(F.col("embedding").cast("array<double>").alias("e"), (F.col("vec_id") % 4).cast("int").alias("tag"))
    rows = _sequences(table(spark, sf_dir, "embeddings").select("label", "vec_id", e.alias("e")))
    return rows.select("label", "run", F.col("steps.e").alias("steps"), F.col("steps.tag").alias("tags"))


@query("crf_curve")
def crf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning curve of a CRF over the tagged sequences, validated on every fifth run."""
    rows = cut(_tagged(spark, sf_dir))
    net = training.SequenceNet(64, 4, "crf", layers=0, two_way=False, forbidden=((0, 3),))
    _, history = training.fit(net, rows.filter("run % 5 <> 1"), rows.filter("run % 5 = 1"), "steps", "tags", epochs=4, rate=0.05)
    return rounded(spark.createDataFrame([(k, *h) for k, h in enumerate(history)], "epoch int, loss double, held_loss double, held_right double"))


@query("recurrent_curve")
def recurrent_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning curve of a GRU that tells a conversation's turns by role from the lengths of their words, one step a word."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    steps = F.transform(words, lambda w: F.array((F.length(w) / 10.0), F.when(w.rlike("[A-Z]"), 1.0).otherwise(0.0), F.when(w.rlike("[.,?]"), 1.0).otherwise(0.0)))
    rows = cut(table(spark, sf_dir, "conversations").select("conv_id", steps.alias("steps"), (F.col("role") == "user").cast("int").alias("y")))
    net = training.SequenceNet(3, 2, "class", "gru", hidden=6)
    _, history = training.fit(net, rows.filter("conv_id % 5 <> 0"), rows.filter("conv_id % 5 = 0"), "steps", "y", epochs=3, batches=2, rate=0.05)
    return rounded(spark.createDataFrame([(k, *h) for k, h in enumerate(history)], "epoch int, loss double, held_loss double, held_right double"))


@query("recurrent")
def recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last step of a bidirectional GRU with seeded weights over sequences of vectors, then dense layers."""
    import numpy as np

    ship(spark)
    rng = np.random.default_rng(3)
    sides = [{"W": rng.normal(size=(24, 64)) / 8, "U": rng.normal(size=(24, 8)) / 4, "b": np.zeros(24), "c": np.zeros(24)} for _ in range(2)]
    net, head = neural.Recurrent("gru", 8, [sides]), [(rng.normal(size=(5, 16)), np.zeros(5))]
    rows = _sequences(table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e")))
    encoded = rows.select("label", "run", neural.encode_udf(lambda x: neural.dense(net.forward(x)[:, -1:], head))("steps").alias("out"))
    return encoded.select("label", "run", X.argmax(F.get("out", F.lit(0))).alias("best"))


# -- models ---------------------------------------------------------------------------------------------------------


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    df = _labelled(spark, sf_dir).withColumn("chars", F.col("n_chars").cast("double")).withColumn("english", (F.col("lang") == "en").cast("double")).withColumn("origin", F.substring("source", 4, 3).cast("double"))
    return df, ["chars", "english", "origin"]


@query("tree_rules")
def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _sample(spark, sf_dir)
    forest = models.ModelSet("classifier").fit("RandomForestClassifier", df, names, "quality", n_estimators=5, max_depth=3)
    return trees.forest_rules(spark, forest.stages[-1], names)


@query("rule_list")
def rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _sample(spark, sf_dir)
    return df.select("doc_id", trees.RuleList(2, 3).fit(df, names, "quality").score().alias("precision"))


@query("tree_drawing")
def tree_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _sample(spark, sf_dir)
    forest = models.ModelSet("classifier").fit("RandomForestClassifier", df, names, "quality", n_estimators=1, max_depth=2)
    return spark.createDataFrame([(trees.draw(jvm.tree_nodes(forest.stages[-1].trees[0]), names),)], "tree string")


@query("model_scores")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _sample(spark, sf_dir)
    zoo = models.ModelSet("classifier")
    zoo.fit("LogisticRegression", df, names, "quality")
    return zoo.predict("LogisticRegression", df).select("doc_id", "score")


@query("boosted_scores")
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a boosted classifier that stops early by the AUC of a fifth of the rows."""
    df, names = _sample(spark, sf_dir)
    zoo = models.ModelSet("classifier", {"XGBClassifier": {"model_para": {"n_estimators": 8, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8, "random_state": 233}, "fit_para": {"early_stopping_rounds": 3}}})
    zoo.fit("XGBClassifier", df.withColumn("held", F.col("doc_id") % 5 == 0), names, "quality", validation="held")
    return zoo.predict("XGBClassifier", df).select("doc_id", "score")


ROUND_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("boosted_round", f"""
WITH v AS ({" UNION ALL ".join(f"SELECT {k} AS f, {c} AS x, CASE WHEN l_returnflag = 'R' THEN -0.5 ELSE 0.5 END AS g FROM lineitem" for k, c in enumerate(ROUND_FEATURES))}),
b AS (SELECT f, x, CAST(sum(g) AS DOUBLE) AS g, count(*) / 4.0::DOUBLE AS h FROM v GROUP BY f, x),
c AS (SELECT f, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS ga, sum(h) OVER (PARTITION BY f) AS ha FROM b WINDOW w AS (PARTITION BY f ORDER BY x)),
s AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM c WHERE hl < ha)
SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, round(CAST(x AS DOUBLE), 4) AS threshold, round(gain, 4) AS gain, round(-0.1 * gl / (hl + 1), 6) AS below, round(-0.1 * (ga - gl) / (ha - hl + 1), 6) AS above
FROM s ORDER BY s.gain DESC, f, x LIMIT 1""")  # fmt: skip
def boosted_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cut of a boosted classifier over the whole table: feature, threshold, gain, and the values of both sides."""
    lines = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    model = boosting.fit(lines, ROUND_FEATURES, "y", boosting.Parameters(n_estimators=1, max_depth=1))
    f, last, _ = model.trees[0].cuts[0]
    row = (ROUND_FEATURES[f], round(model.edges[f][last], 4), round(model.trees[0].gains[0], 4), round(model.trees[0].leaves[1], 6), round(model.trees[0].leaves[2], 6))
    return spark.createDataFrame([row], "feature string, threshold double, gain double, below double, above double")


@query("regression_scores", """
WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
s AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt, avg(y) AS my, stddev_pop(q) AS sq, stddev_pop(d) AS sd, stddev_pop(t) AS st, stddev_pop(y) AS sy, 1 + 1 / stddev_pop(y) AS k,
  corr(q, d) AS qd, corr(q, t) AS qt, corr(d, t) AS dt, corr(q, y) AS qy, corr(d, y) AS dy, corr(t, y) AS ty FROM x),
w AS (SELECT *, k * (k * k - dt * dt) - qd * (qd * k - dt * qt) + qt * (qd * dt - k * qt) AS det,
  qy * (k * k - dt * dt) - qd * (dy * k - dt * ty) + qt * (dy * dt - k * ty) AS wq,
  k * (dy * k - dt * ty) - qy * (qd * k - dt * qt) + qt * (qd * ty - dy * qt) AS wd,
  k * (k * ty - dy * dt) - qd * (qd * ty - dy * qt) + qy * (qd * dt - k * qt) AS wt FROM s),
p AS (SELECT y, my + sy * (wq * (q - mq) / sq + wd * (d - md) / sd + wt * (t - mt) / st) / det AS p FROM x, w)
SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 3) AS mae, round(avg((y - p) * (y - p)), 0) AS mse FROM p""")
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression; its SQL solves the three normal equations of standardised columns by Cramer's rule."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    zoo = models.ModelSet("regressor")
    zoo.fit("Ridge", lines, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    found = evaluate.regression_metrics(zoo.predict("Ridge", lines), "l_extendedprice", "score")
    return found.select(F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"))
