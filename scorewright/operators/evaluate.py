"""Evaluation curves and metrics as tables.

Scores are first collapsed to one row for each distinct score, so ties can't tear a curve. Running sums over all scores
are two-level: scores are cut into ranges at approximate quantiles, sums run within a range in parallel, and each range starts from the total
of those before it. No task orders the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.operators.ranges import marks, range_number
from scorewright.operators.selection import column_quantiles
from scorewright.session import cut


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg for each distinct score, with a range number `part` (0: highest scores)."""
    counts = df.select(F.col(score).cast("double").alias("score"), F.col(label).alias("y")).filter("score IS NOT NULL AND y IS NOT NULL")
    counts = counts.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    cuts = marks(counts, F.col("score"))
    return counts.withColumn("part", len(cuts) - range_number(F.col("score"), cuts))


def running(counts: DataFrame, columns: list[str], last: bool = False) -> DataFrame:
    """counts with running sums c_<column> over descending score, and totals t_<column>."""
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = counts.withColumns({f"c_{c}": F.sum(c).over(w) for c in columns})
    parts = counts.groupBy("part").agg(*[F.sum(c).alias(f"p_{c}") for c in columns])
    every = Window.partitionBy(F.lit(0))  # a row for each range
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(f"p_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in columns], *[F.sum(f"p_{c}").over(every).alias(f"t_{c}") for c in columns])
    joined = within.join(F.broadcast(parts), "part")
    return joined.withColumns({f"c_{c}": F.col(f"c_{c}") + F.col(f"b_{c}") for c in columns}).drop("part", *[f"b_{c}" for c in columns])


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """score (threshold), fpr, tpr for each distinct score, and the counts behind them."""
    r = running(score_counts(df, score, label), ["pos", "neg"])
    return r.withColumns({"fpr": F.try_divide(F.col("c_neg"), F.col("t_neg")), "tpr": F.try_divide(F.col("c_pos"), F.col("t_pos"))})


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc, by trapezoids. Each score's trapezoid needs its own counts only: no lag over the whole curve."""
    r = roc_curve(df, score, label)
    area = F.col("neg").cast("double") * (F.col("c_pos") - F.col("pos") / 2.0)
    return r.agg((F.sum(area) / F.max(F.col("t_pos").cast("double") * F.col("t_neg"))).alias("auc"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ks = max(tpr - fpr)."""
    return roc_curve(df, score, label).agg(F.max(F.col("tpr") - F.col("fpr")).alias("ks"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, prec, recall, f1 (null where both are 0)."""
    r = running(score_counts(df, score, label), ["pos", "neg"])
    r = r.withColumns({"prec": F.col("c_pos") / (F.col("c_pos") + F.col("c_neg")), "recall": F.try_divide(F.col("c_pos"), F.col("t_pos"))})
    return r.withColumn("f1", F.try_divide(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")))


def max_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    return pr_curve(df, score, label).agg(F.max("f1").alias("max_f1"))


def real_pr_curve(df: DataFrame, score: str, label: str, ratio: float) -> DataFrame:
    """The PR curve at the real ratio of positives to negatives: score, recall, prec_real."""
    r = running(score_counts(df, score, label), ["pos", "neg"])
    return r.select("score", F.try_divide(F.col("c_pos"), F.col("t_pos")).alias("recall"), real_precision(F.col("c_pos"), F.col("c_neg"), F.col("t_pos"), F.col("t_neg"), ratio).alias("prec_real"))


def real_precision(tp: Column, fp: Column, pos: Column, neg: Column, ratio: float) -> Column:
    recall, negative = F.try_divide(tp.cast("double"), pos), F.try_divide(fp.cast("double"), neg)
    return F.try_divide(recall * ratio, negative + recall * ratio)


def top_percent(df: DataFrame, score: str, label: str, ties: list[str]) -> DataFrame:
    """pct (1 to 100), n = int(pct * rows / 100), prec of the n highest scores (null for none). `ties` make the order total.

    Rows are dealt by ranges of the whole order, ties included, so one score that many rows share is many ranges. The dealt rows are
    written once: ranges and their sizes can't disagree. A prefix's positives are a sum over ranks, taken for all 100 in one pass."""
    rows = df.select(F.col(score).cast("double").alias("score"), (F.col(label) == 1).cast("int").alias("hit"), *ties).filter("score IS NOT NULL")
    ranges = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartitionByRange(ranges, F.desc("score"), *ties).withColumn("part", F.spark_partition_id()))
    n = rows.count()
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), *ties)) + F.col("before")
    ranked = rows.join(F.broadcast(sizes), "part").select("hit", rank.alias("rank"))
    # the first percentage whose prefix holds the rank, then a running sum over 100 rows
    first = F.ceil(F.col("rank") * 100 / n).cast("int")
    first = F.when(F.floor(first * F.lit(n) / 100) >= F.col("rank"), first).otherwise(first + 1)
    hits = ranked.groupBy(first.alias("pct")).agg(F.sum("hit").alias("hits"))
    grid = df.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("pct"))
    total = F.sum(F.coalesce("hits", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("pct").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.floor(F.col("pct") * F.lit(n) / 100).cast("long")
    return grid.join(hits, "pct", "left").select("pct", size.alias("n"), F.try_divide(total.cast("double"), size).alias("prec"))


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """One row: r2, mae, mse."""
    a, p = F.col(y).cast("double"), F.col(predicted).cast("double")
    both = df.filter(a.isNotNull() & p.isNotNull())
    return both.agg((1 - F.try_divide(F.avg((a - p) * (a - p)), F.var_pop(a))).alias("r2"), F.avg(F.abs(a - p)).alias("mae"), F.avg((a - p) * (a - p)).alias("mse"))


def histogram_by_label(df: DataFrame, col: str, label: str, bins: int = 50, category: bool = False) -> DataFrame:
    """label, bin (text), share: the distribution of a column within each label, to be drawn side by side. Shares are of the label's
    rows with a value, so they sum to 1.

    Numbers: the range runs from the least max(p25 - 3 IQR, min) to the largest min(p75 + 3 IQR, max) over labels; with
    fewer distinct values than bins the values themselves are the bins, with one beyond either end."""
    x = F.col(col)
    if category:
        counts = df.filter(x.isNotNull()).groupBy(F.col(label).alias("label"), x.cast("string").alias("bin")).agg(F.count("*").alias("n"))
        return counts.select("label", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))
    x = x.cast("double")
    reach = list(column_quantiles(df, [col], [0.25, 0.75], by=label).values())  # labels are drawn side by side: a few
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    low = min((max(a - 3 * (b - a), ends["lo"]) for a, b in reach), default=None)
    high = max((min(b + 3 * (b - a), ends["hi"]) for a, b in reach), default=None)
    inside = df.filter(x.between(low, high)).select(x.alias("v")).distinct().limit(bins).count()
    if inside < bins:
        bin_ = F.when(x < low, F.lit(f"(-inf,{low})")).when(x > high, F.lit(f"({high},inf)")).otherwise(x.cast("string"))
    else:
        width = (high - low) / (bins - 1)
        number = F.least(F.greatest(F.ceil((x - low) / width), F.lit(1)), F.lit(bins))
        bin_ = number.cast("string")
    counts = df.filter(x.isNotNull()).groupBy(F.col(label).alias("label"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("label", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))


def accuracy(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(label)).cast("int")).alias("accuracy"))
