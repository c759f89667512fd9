"""Whole tables and many leftovers: no row may be left out, whatever its share of the input."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F


def test_language_with_mostly_copies_is_learnt(spark, monkeypatch):
    language = pytest.importorskip("scorewright.llm.language")
    taught, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda texts, languages: taught.append(Counter(languages)) or fit(texts, languages))
    english = [(f"the cat number {k} sat on the mat and the hat", "en") for k in range(3000)]
    french = [(f"le chat {k} est sur la table avec une chaise", "fr") for k in range(300)] + [("une phrase qui est partout la même", "fr")] * 9000
    model = language.learn(spark.createDataFrame(english + french, "text string, lang string"), F.lit(True), per_language=100)
    assert 60 < taught[0]["en"] < 140 and 60 < taught[0]["fr"] < 140
    assert model.predict("le chat est avec la chaise")[0] == "fr"


def test_later_batches_lose_rows_to_the_index(spark, sf_dir, monkeypatch):
    """Each batch is anti-joined with the digests of those before it; what it loses are copies of their rows."""
    exact_dedup = pytest.importorskip("scorewright.llm.exact_dedup")
    offered, held, append = [], [], exact_dedup.DigestIndex.append

    def counted(self, groups):
        offered.append({bytes(r["sha"]) for r in groups.collect()})
        append(self, groups)
        held.append({bytes(r["sha"]): r["keep_id"] for r in self.rows().collect()})

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", counted)
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(200)] + [(None, "text 3"), (None, "null only")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(offered) == exact_dedup.BATCHES and len(offered[0]) == 40
    for k in range(1, exact_dedup.BATCHES):
        assert set(held[k - 1]) & offered[k] and set(held[k]) == set(held[k - 1]) | offered[k]
        assert {s: held[k][s] for s in held[k - 1]} == held[k - 1]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == Counter([(k, k % 40, 6 if k % 40 == 3 else 5, k < 40) for k in range(200)] + [(None, 3, 6, False), (None, None, 1, True)])
    assert exact_dedup.op4(spark, sf_dir).count() == pq.read_metadata(f"{sf_dir}/documents.parquet").num_rows


def test_keep_first_of_a_row_repeated_very_often(spark):
    exact_dedup = pytest.importorskip("scorewright.llm.exact_dedup")
    docs = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.lit(None)).cast("long").alias("doc_id"), F.concat(F.lit("same  "), F.repeat(F.lit("text "), 200)).alias("text"), F.lit(1).alias("number"), F.lit("s").alias("sha"))
    kept = exact_dedup.keep_first(docs).collect()
    assert [(r["doc_id"], r["number"], r["sha"]) for r in kept] == [(5, 1, "s")]
    index = exact_dedup.DigestIndex(spark)
    assert exact_dedup.keep_first(docs.filter("doc_id = 5"), index=index).count() == 1
    assert exact_dedup.keep_first(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(4).cast("long")), index=index).count() == 0
    index.drop()


def test_best_fit_of_many_leftovers():
    packing = pytest.importorskip("scorewright.llm.packing")
    rng = np.random.default_rng(6)
    for _ in range(50):
        histogram = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 32), 8, replace=False), rng.integers(1, 30, 8), strict=True)}
        rooms = []
        for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):  # one by one
            room = min((r for r in rooms if r >= x), default=32)
            if room in rooms:
                rooms.remove(room)
            rooms.append(room - x)
        found = packing.best_fit(histogram, 32)
        assert sorted(32 - sum(x * c for x, c in p.items()) for p, n in found for _ in range(n)) == sorted(rooms)
        assert sum((Counter({x: c * n for x, c in p.items()}) for p, n in found), Counter()) == Counter(histogram)
    rows = packing.layout({3: 120_017, 11: 84_562, 27: 111_411, 29: 24_893}, 64)
    assert sum((b - a) * length for length, a, b, _, _, _, stream in rows if stream is not None) < 3_500_000  # 5,020,227 end to end without best-fit


def test_giant_components(spark):
    """A star of 200,000 nodes, a long chain and small groups: all nodes get the least one; hot keys aren't dealt by key."""
    near_dedup = pytest.importorskip("scorewright.llm.near_dedup")
    from scorewright.llm.common import Scratch

    star = spark.range(1, 200_000, 1, 8).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(300_000, 300_300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    pairs = spark.range(400_000, 440_000, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = near_dedup.components(star.unionByName(chain).unionByName(pairs), Scratch(spark, "test"), "giant")
    least = F.when(F.col("node") < 200_000, 0).when(F.col("node") < 400_000, 300_000).otherwise(F.col("node") - F.col("node") % 2)
    assert found.count() == 200_000 + 301 + 40_000 and found.filter(F.col("component") != least).count() == 0


def test_joins_with_hot_keys(spark):
    near_dedup = pytest.importorskip("scorewright.llm.near_dedup")
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 2).alias("h"), "id")
    right = spark.createDataFrame([(k, h, f"{k}-{h}") for k in range(40) for h in (0, 1)], "k long, h long, v string")
    found = near_dedup.join_hot(left, right, ["k", "h"])
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, found.select("k", "h", "id", "v").collect())) == Counter(map(tuple, left.join(right, ["k", "h"]).select("k", "h", "id", "v").collect()))


def test_boilerplate_without_links(spark, monkeypatch):
    """Texts that share half of their words fill common buckets; no pair may be a link, so no text is sent to a tile."""
    near_dedup = pytest.importorskip("scorewright.llm.near_dedup")
    sent, keep = [], near_dedup.Scratch.keep
    monkeypatch.setattr(near_dedup.Scratch, "keep", lambda self, df, label, *more: sent.append((label, kept := keep(self, df, label, *more))) or kept)
    shared = " ".join(f"common{k}" for k in range(70))
    items = [(k, f"{shared} " + " ".join(f"w{k}x{j}" for j in range(70))) for k in range(1500)]
    items += [(5000 + k, items[k][1] + " more") for k in range(5)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(items, "doc_id long, text string").repartition(6)).collect()}
    assert found == {k: k for k in range(1500)} | {5000 + k: k for k in range(5)}
    tables = dict(sent)
    assert tables["there"].count() > 3_000 and tables["near"].count() < 100
