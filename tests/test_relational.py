"""Amounts of contracts against the ranking by a window; small checks of functions without a query of their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions import aggregates
from scorewright.operators import neural, relational


def test_amounts_equal_the_ranking(spark):
    """Null amounts, contracts and entities, ties, a contract with most of the rows."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 13 == 0 else int(rng.integers(5)), "hot" if k % 3 else [None, "a", "b", "c"][int(rng.integers(4))], None if k % 7 == 0 else float(rng.integers(6)), int(rng.integers(100)), ["1,2", "2", "3,3,1", ""][int(rng.integers(4))], k) for k in range(400)]
    rows += [(9, "lone", None, 5, "4", 1000)]
    df = spark.createDataFrame(rows, "e int, c string, a double, paid int, p string, id int").repartition(3)
    found = relational.times_amount(df, "e", "c", F.split("p", ","), "a", "paid", [F.col("id")])
    x = df.select("e", "c", "a", "paid", "id", F.explode(F.split("p", ",")).alias("period"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy(F.col("a").desc(), "id", "period")))
    n = F.countDistinct("period")
    g = x.groupBy("e", "c").agg(n.alias("n"), (n * F.sum(F.when(F.col("rn") == 1, F.col("a")).otherwise(0))).alias("amt"), F.max("paid").alias("paid"))
    wanted = g.groupBy("e").agg(F.max("paid"), F.sum("n"), F.sum("amt"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_scalar_functions_in_sql(spark):
    def squared(x: pd.Series) -> pd.Series:
        return x * x

    aggregates.register_sql(spark, "squared_here", squared, "double")
    assert [r[0] for r in spark.sql("SELECT squared_here(CAST(id AS DOUBLE)) FROM range(4) ORDER BY id").collect()] == [0.0, 1.0, 4.0, 9.0]


def test_forbidden_tags():
    moves = neural.forbid(np.zeros((4, 4)), 2, 3)
    _, path = neural.viterbi(np.array([[0.0, 1, 0, 0], [0, 0, 9, 0], [0, 0, 0, 9], [1, 0, 0, 0]]), moves)
    assert 2 not in path[1:] and 3 not in path[:-1]
    assert (moves[2] == -10_000).all() and (moves[:, 3] == -10_000).all() and pytest.approx(0) == moves[0, 0]
