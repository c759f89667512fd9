"""The registered queries and the pipeline on the small tables."""

from collections import Counter

import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F

from scorewright.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLE_SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    from test_operators import normal, shingle_set

    docs, columns, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        columns = columns or docs.columns
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["near_dedup"]) <= set(kept["exact_dedup"]) <= set(kept["language"]) <= set(kept["quality"])
    assert Counter(map(normal, kept["exact_dedup"].values())).most_common(1)[0][1] == 1
    sets = [shingle_set(t) for t in kept["near_dedup"].values()]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept["quality"] for d in good) >= 0.95 * len(good)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(kept["near_dedup"])


CLASHING = ["kept_id", "kept_sha", "__sha", "__copy", "__key", "__number", "mid", "class", "key", "number", "others", "component", "others.x"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing names: every stage keeps all columns and, of what stays, all values."""
    from test_operators import ROWS, SCHEMA, normal, roots

    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
        rows = found.collect()
        kept = Counter(map(tuple, rows))
        assert not kept - before, name
        every = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        if name == "exact_dedup":
            groups = {}
            for d, t in every:
                old = groups.setdefault(normal(t), d)
                groups[normal(t)] = d if old is None else old if d is None else min(old, d)
            assert Counter((r["doc_id"], normal(r["text"] or "")) for r in rows) == Counter((d, t) for t, d in groups.items())
        if name == "near_dedup":
            assert len(rows) == len(set(roots(every)[0]))
        docs, before = spark.createDataFrame(rows, docs.schema), kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group(spark):
    """Rows with null, repeated and clashing ids in the two dedup stages, on all rows of the odd table."""
    from test_operators import ROWS, SCHEMA, normal, shingle_set

    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    exact = corpus_pipeline.exact_stage(spark, docs, "").collect()
    assert sorted(normal(r["text"] or "") for r in exact) == sorted({normal(r[1] or "") for r in ROWS})
    near = corpus_pipeline.near_stage(spark, docs, "").collect()
    texts = [r["text"] or "" for r in near]
    assert Counter(t for t in texts if not shingle_set(t)) == Counter(r[1] or "" for r in ROWS if not shingle_set(r[1] or ""))
    sets = [s for t in texts if (s := shingle_set(t))]
    every = [s for r in ROWS if (s := shingle_set(r[1] or ""))]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(any(100 * len(a & b) > 50 * len(a | b) for b in sets) for a in every)
