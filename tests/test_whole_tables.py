"""Queries over whole tables against plain versions: no row of the input may be left out."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scorewright import catalog
from scorewright.operators import neural


def test_column_filters_keep_every_row(spark, sf_dir):
    found = catalog.QUERIES["column_filters"](spark, sf_dir)
    assert sorted(found.columns) == ["l_orderkey", "quantity"]
    rows = pq.read_table(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_quantity"]).to_pylist()
    assert Counter(map(tuple, found.select("l_orderkey", "quantity").collect())) == Counter((r["l_orderkey"], None if r["l_quantity"] > 40 else r["l_quantity"]) for r in rows)


def _attended(rows):
    """id -> attention of each (group, id, vector) over all vectors of its group."""
    out = {}
    for group in {g for g, _, _ in rows}:
        ids, v = [i for g, i, _ in rows if g == group], np.array([x for g, _, x in rows if g == group], float)
        w = np.exp(v @ v.T - (v @ v.T).max(axis=1, keepdims=True))
        out |= dict(zip(ids, w @ v / w.sum(axis=1, keepdims=True), strict=True))
    return out


def test_attention_of_every_vector(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    right = _attended([(r["label"], r["vec_id"], r["embedding"]) for r in rows])
    found = {r["vec_id"]: (r["first"], r["last"]) for r in catalog.QUERIES["attention"](spark, sf_dir).collect()}
    assert found.keys() == right.keys() and len(found) == len(rows) > 200
    assert all(found[i] == (pytest.approx(a[0], abs=2e-6), pytest.approx(a[63], abs=2e-6)) for i, a in right.items())


def test_attention_merges_key_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("big" if k < 90 else f"g{k % 4}", k, (30 * rng.normal(size=3)).tolist()) for k in range(120)]  # scores far over what exp() holds
    odd = [("big", 500, None), ("big", 501, []), (None, 502, [1.0, 2.0, 3.0])]
    found = neural.self_attention(spark.createDataFrame(rows + odd, "g string, k long, v array<double>"), "g", "k", "v", block_rows=16).collect()
    got, right = {r["id"]: r["a"] for r in found}, _attended(rows)
    assert len(found) == len(got) == 122 and got.pop(500) is None and got.pop(501) is None
    assert got.keys() == right.keys() and all(got[i] == pytest.approx(a) for i, a in right.items())


def test_full_outer_counts_every_key(spark, sf_dir, tmp_path):
    def found(folder):
        return Counter(map(tuple, catalog.QUERIES["full_outer_fill"](spark, folder).select("k", "orders_n", "customers_n").collect()))

    orders, customers = (Counter(pq.read_table(f"{sf_dir}/{t}.parquet", columns=[c])[c].to_pylist()) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey")))
    assert found(sf_dir) == Counter((k, orders[k], customers[k]) for k in orders.keys() | customers.keys())
    spark.createDataFrame([(1,), (1,), (35,), (None,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (70,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert found(str(tmp_path)) == Counter([(1, 2, 1), (35, 1, 0), (70, 0, 1), (None, 1, 0), (None, 0, 1)])


@pytest.mark.parametrize("name", ["viterbi", "recurrent"])
def test_every_component_counts(spark, sf_dir, tmp_path, name):
    whole = pq.read_table(f"{sf_dir}/embeddings.parquet")
    v = np.array(whole["embedding"].to_pylist())
    v[:, 16:] = 3 * np.random.default_rng(9).normal(size=v[:, 16:].shape)  # the first 16 components stay
    other = whole.set_column(whole.column_names.index("embedding"), "embedding", pa.array(v.tolist(), whole["embedding"].type))
    pq.write_table(other, f"{tmp_path}/embeddings.parquet")
    found = [sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())) for folder in (sf_dir, str(tmp_path))]
    assert len(found[0]) == len(found[1]) and found[0] != found[1]
