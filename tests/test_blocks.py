"""Lookups by blocks and batches by ranges against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import text


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(text, "BLOCK_ITEMS", 7)


def lists():
    rng = np.random.default_rng(5)
    rows = [(k, [["the", "of", "x", None, "rare", f"w{int(v)}"][int(v) % 6] for v in rng.integers(0, 60, int(rng.integers(0, 12)))]) for k in range(60)]
    return rows + [(3, ["the"]), (None, ["of", "the"]), (100, None), (101, []), (102, ["the", "of"] * 500)]


def test_tokens_are_looked_up_by_blocks(spark, small_blocks):
    """Repeated and null keys, null and empty lists, null tokens, a row longer than a block, several partitions."""
    rows = lists()
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    known = {"the": 2, "of": 3, "w5": 9, "w11": 10}
    vocab = spark.createDataFrame(list(known.items()), "word string, idx long")
    found = sorted(((r["id"], r["input_ids"]) for r in text.index_tokens(df, "id", "tokens", vocab, oov=1).collect()), key=repr)
    assert found == sorted(((k, [known.get(w, 1) for w in t or []]) for k, t in rows), key=repr)
    assert text.index_tokens(df.limit(0), "id", "tokens", vocab).collect() == []
    assert all(set(r["input_ids"]) <= {0} for r in text.index_tokens(df, "id", "tokens", vocab.limit(0)).collect())


def test_vectors_are_looked_up_by_blocks(spark, small_blocks):
    rng = np.random.default_rng(6)
    table = {k: [float(v) for v in rng.integers(-9, 9, 3)] for k in range(2, 9)}
    rows = [(k, [int(v) for v in rng.integers(0, 12, int(rng.integers(0, 9)))]) for k in range(50)] + [(7, None), (8, [2] * 300)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").repartition(4)
    vectors = spark.createDataFrame(list(table.items()), "idx int, vec array<float>")
    found = sorted(((r["id"], r["vectors"]) for r in text.embed(df, "id", "ids", vectors, 3).collect()), key=repr)
    assert found == sorted(((k, [table.get(i, [0.0] * 3) for i in ids or []]) for k, ids in rows), key=repr)
    plan = text.embed(df, "id", "ids", vectors, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # no row a place


def test_rows_of_one_length_are_many_tasks(spark):
    """All rows of one length: batches of the whole order, and each range has a part of them."""
    df = spark.range(0, 20_000, 1, 5).select("id", F.lit(7).alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = text.batches(df, "n", 64, ["id"]).withColumn("task", F.spark_partition_id())
        assert {r["id"]: r["batch_id"] for r in found.collect()} == {k: min(k // 64, 20_000 // 64 - 1) for k in range(20_000)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_padding_of_batches(spark):
    df = spark.createDataFrame([(k, k // 3, list(range(1, 1 + k % 5))) for k in range(12)], "id int, b int, ids array<int>")
    found = {r["id"]: r["ids"] for r in text.shuffle_batches(text.pad_batches(df, "b", "ids"), "b", 3).collect()}
    for k in range(12):
        width = max(j % 5 for j in range(k // 3 * 3, k // 3 * 3 + 3))
        assert found[k] == [0] * (width - k % 5) + list(range(1, 1 + k % 5))
    orders = [[r["b"] for r in text.shuffle_batches(df, "b", seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(orders[2]) and all(len({o[k], o[k + 1], o[k + 2]}) == 1 for o in orders for k in range(0, 12, 3))
