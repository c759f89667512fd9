import time
from dataclasses import replace

import pytest
from compare import rows_of
from pyspark.sql import functions as F

from scorewright.operators import models, trees
from scorewright.plans import features, lineage, sqlgen
from scorewright.plans.specs import FeatureSpec, TableSpec
from scorewright.sources import readers, writers
from scorewright.streaming.features import windowed_features

TABLE = TableSpec.from_dict({
    "database": "d", "table": ["flow", "it's a flow"], "entitys": [["U", "bigint", "user"]], "dimensions": [["CH", "string", "channel"], ["AMT", "double", "amount"]],
    "winpos_col": [["DAY", "int", "days"]], "win_nm": ["w1", "w2"], "partitioned_by": [["dt", "string", "day"], ["hr", "string", "hour"]], "clustered_by": ["U"], "bucket_num": 4, "location": "/x/",
})
SPEC = FeatureSpec.from_dict({"tag": "T", "objects": ["AMT"], "function": ["SUM", "PCTCNT_CH"], "condition_cols": [("CH", [("COL='A'", "ch A", "a"), ("COL='B'", "ch B", "b")]), ("DAY", [("COL<=30", "30 days", "d30")])]})


def test_expansion():
    found = features.expand(SPEC, TABLE, "w1")
    assert [f.alias for f in found] == ["T__SUM__AMT__a__d30", "T__SUM__AMT__b__d30", "T__PCTCNTCH__AMT__d30__a", "T__PCTCNTCH__AMT__d30__b"]
    assert found[0].predicate == "1=1 and (CH='A') and (DAY_w1<=30)"
    assert (found[2].predicate, found[2].base_predicate) == ("1=1 and (DAY_w1<=30) and (CH='A')", "1=1 and (DAY_w1<=30)")
    assert found[0].comment == "AMT|SUM|$|ch A|30 days"


def test_errors():
    def spec(**kw):
        return FeatureSpec.from_dict({"tag": "T", "objects": ["AMT"], "function": ["SUM"]} | kw)

    for bad in (spec(objects=["NOPE"]), spec(function=["PCTSUM_AMT"]), spec(condition_cols=[("NOPE", [("COL=1", "", "x")])]), spec(function=["WHAT"])):
        with pytest.raises(ValueError):
            features.expand(bad, TABLE)
    with pytest.raises(ValueError):
        features.expand(SPEC, TABLE, "w9")
    with pytest.raises(ValueError):
        features.expand_all([SPEC, SPEC], ["U"], TABLE, "w1")
    with pytest.raises(ValueError):
        features.expand_all([SPEC], ["NOPE"], TABLE, "w1")


def test_word_boundary_and_cast():
    spec = FeatureSpec.from_dict({"tag": "t", "objects": ["AMT"], "function": ["sum"], "condition_cols": [("CH", [("cast(COL as int)=1 and COLOR=2", "", "x")])]})
    assert features.expand(spec)[0].predicate == "1=1 and (cast(CH as int)=1 and COLOR=2)"


def test_sql_equals_columns(spark):
    df = spark.createDataFrame([(1, "A", 10.0, 5), (1, "B", 20.0, 50), (2, "A", None, 3), (2, None, 4.0, 1)], "U long, CH string, AMT double, DAY_w1 int")
    every = ["SUM", "AVG", "MAX", "MID", "MIN", "STD", "COUNT", "CNT", "CNTDIST", "SUMABS", "MAXABS", "MINABS", "AVGABS", "SKEW", "PCTSUM_CH", "PCTCNT_CH", "PCTCNTDIST_DAY"]
    spec = FeatureSpec(SPEC.tag, SPEC.objects, tuple(every), SPEC.condition_cols)
    sql, aliases = sqlgen.feature_sql([spec], ["U"], "{t}", TABLE, "w1")
    columns = features.compute(df, [spec], ["U"], TABLE, "w1")
    assert columns.columns == ["U", *aliases]
    assert rows_of(spark.sql(sql, t=df)) == rows_of(columns) == rows_of(features.compute(df, [spec], ["U"], TABLE, "w1"))


def test_ddl_parses(spark):
    for stored in ("parquet", "textfile"):
        text = sqlgen.table_ddl(replace(TABLE, stored_as=stored))
        assert text.count("dt string") == 1 and "DAY_w2 int comment 'days'" in text
        assert ("fields terminated by ','" in text) == (stored == "textfile")
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))


def test_lineage_details(spark):
    script = "create table if not exists a.b as select ';' x from c.d, e.f -- from g.h;\n; insert into I.J select * from (select * from k) t where x in (select y from l)"
    assert {tuple(r) for r in lineage.edges(spark, script).collect()} == {("c.d", "a.b"), ("e.f", "a.b"), ("k", "i.j"), ("l", "i.j")}
    edges = lineage.edges(spark, script)
    assert lineage.cypher(edges, "p").startswith("create\n(node_0:table{name:'a.b',project_tag:'p'})")
    both = lineage.tagged(edges, "p").union(lineage.tagged(edges, "q"))
    assert lineage.without_tag(both, "p").count() == 4


def test_closure_of_a_long_chain(spark):
    began = time.perf_counter()
    found = lineage.closure(spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(300)], "src string, dst string"))
    assert found.count() == 300 * 301 // 2 and time.perf_counter() - began < 60


def test_no_row_is_expanded_for_distinct_counts(spark):
    rows = [(k % 5, k % 7, k % 3 if k % 4 else None) for k in range(400)]
    spec = FeatureSpec.from_dict({"tag": "T", "objects": ["b", "c"], "function": ["CNTDIST", "PCTCNTDIST_B", "SUM"], "condition_cols": [("b", [(f"COL>{x}", f"over {x}", f"o{x}") for x in range(4)])]})
    found = features.compute(spark.createDataFrame(rows, "a int, b int, c int"), [spec], ["a"])
    assert "Expand" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        for x in range(4):
            mine = [(b, c) for a, b, c in rows if a == r["a"]]
            over = {c for b, c in mine if b > x and c is not None}
            assert r[f"T__CNTDIST__c__o{x}"] == len(over)
            assert r[f"T__PCTCNTDISTB__c__o{x}"] == pytest.approx(len(over) / len({c for _, c in mine if c is not None}))


def test_closure_of_a_cycle(spark):
    assert lineage.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).count() == 4


def test_readers(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 0.1 0.2\nof 1 2\nthe 9 9\n")
    assert {r["word"]: [round(x, 1) for x in r["vec"]] for r in readers.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"the": [0.1, 0.2], "of": [1.0, 2.0]}
    (tmp_path / "t.txt").write_text("A B\nc D\n\ne F\n")
    rows = readers.read_tagged(spark, str(tmp_path / "t.txt")).orderBy("sentence_id", "pos").collect()
    assert [(r["token"], r["tag"]) for r in rows] == [("A", "B"), ("c", "D"), ("e", "F")] and len({r["sentence_id"] for r in rows}) == 2
    (tmp_path / "p.tsv").write_text("PhraseId\tPhrase\tSentiment\n1\ta   b \"c\t2\n")
    assert readers.read_phrases(spark, str(tmp_path / "p.tsv")).first()["Phrase"] == 'a b "c'
    (tmp_path / "m.json").write_text('{"a": "http://x", // note\n "b": 1}')
    assert readers.read_parameters(str(tmp_path / "m.json")) == {"a": "http://x", "b": 1}


def test_feature_sheet(spark):
    lines = [("TAG", "t", "", "", ""), ("COMMENT", "c", "", "", ""), ("OBJECTS", "amt", "", "", ""), ("", "fee", "", "", ""), ("FUNCTION", "sum", "", "", ""), ("CONDITION_COLS", "z", "COL='a'", "x", "n1"), ("", "", "col>1", "y", "n2"), ("CONDITION_COLS", "b", "COL=2", "y", "n3"), ("", "", "", "", ""), ("TAG", "u", "", "", ""), ("OBJECTS", "amt", "", "", ""), ("FUNCTION", "max", "", "", "")]
    sheet = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "line int, c0 string, c1 string, c2 string, c3 string, c4 string")
    first, second = readers.feature_specs(sheet)
    assert (first.tag, first.objects, first.function, [c for c, _ in first.condition_cols]) == ("T", ("AMT", "FEE"), ("SUM",), ["Z", "B"])
    assert first.condition_cols[0][1][0].expr == "COL='a'" and second.comment == ""


def test_writers(spark, tmp_path):
    writers.write_submission(spark.createDataFrame([(2, 0), (1, 4)], "PhraseId int, Sentiment int"), "PhraseId", str(tmp_path / "s"))
    assert [r["PhraseId"] for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["1", "2"]
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    writers.write_edges(edges, "p", str(tmp_path / "g"))
    writers.write_edges(edges, "q", str(tmp_path / "g"))
    writers.delete_project(spark, "p", str(tmp_path / "g"))
    assert [r["project_tag"] for r in spark.read.parquet(str(tmp_path / "g")).collect()] == ["q"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    spec = [FeatureSpec("E", ("value",), ("SUM", "COUNT"))]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_features(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), spec, ["event_type"], "ts", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("windows")) == rows_of(windowed_features(events, spec, ["event_type"], "ts", "1 day"))


def test_distinct_counts_on_a_stream(spark, tmp_path):
    """Late rows inside the watermark count, later ones don't; values come again in other batches; sliding windows; nulls. A far event closes all windows."""
    from datetime import datetime, timedelta

    start = datetime(2024, 5, 1)
    spec = [
        FeatureSpec.from_dict({"tag": "E", "objects": ["code"], "function": ["CNTDIST", "PCTCNTDIST_KIND"], "condition_cols": [("kind", [("COL=1", "one", "one"), ("COL>0", "all", "all")])]}),
        FeatureSpec.from_dict({"tag": "V", "objects": ["value"], "function": ["SUM", "COUNT", "MAX"]}),
    ]

    def row(minute, k):
        return (k % 3 if k % 10 else None, start + timedelta(minutes=minute), f"c{k % 7}" if k % 5 else None, k % 4, float(k) if k % 6 else None)

    batches = [[row(k, k) for k in range(0, 120)], [row(k - 8 if k % 3 else k, k * 3) for k in range(120, 240)] + [row(5, 1)], [row(k, k * 5) for k in range(220, 300)], [row(10**5, 4)]]
    schema = "user int, at timestamp, code string, kind int, value double"
    (tmp_path / "in").mkdir()
    stream = windowed_features(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spec, ["user"], "at", "60 minutes", "30 minutes", late="20 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("distincts").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            next((tmp_path / f"b{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
            q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    kept = [r for rows in batches[:-1] for r in rows]
    kept.remove(row(5, 1))  # 115 minutes behind the newest
    wanted = windowed_features(spark.createDataFrame(kept, schema), spec, ["user"], "at", "60 minutes", "30 minutes")
    assert rows_of(spark.table("distincts")) == rows_of(wanted)
    counted = {(r["window_start"], r["user"]): r["E__CNTDIST__code__all"] for r in wanted.collect()}
    for (begin, user), n in counted.items():
        assert n == len({c for u, t, c, kind, _ in kept if u == user and begin <= t < begin + timedelta(hours=1) and c and kind > 0})


def test_rules_and_models(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", (F.col("a") > 6).cast("int"))
    found = trees.RuleList(2, 2).fit(df, ["a", "b"], "y")
    scores = df.select("y", found.score()[1].alias("p")).filter("y = 1").agg(F.min("p")).first()[0]
    assert scores == 1.0
    zoo = models.ModelSet("classifier", {"RandomForestClassifier": {"model_para": {"n_estimators": 3, "max_depth": 2, "n_jobs": -1}}})
    model = zoo.fit("RandomForestClassifier", df, ["a", "b"], "y")
    assert trees.forest_rules(spark, model.stages[-1], ["a", "b"]).count() >= 2 and ("RandomForestClassifier", "n_jobs") in zoo.ignored
    zoo.save("RandomForestClassifier", str(tmp_path / "m"))
    zoo.load("RandomForestClassifier", str(tmp_path / "m"))
    assert zoo.predict("RandomForestClassifier", df).filter("score > 0.5 and y = 0").count() == 0
    tree = {"stats": [5.0, 5.0], "feature": 0, "threshold": 1.5, "left": {"stats": [5.0, 0.0]}, "right": {"stats": [0.0, 5.0]}}
    assert trees.draw(tree, ["a"]).splitlines()[0] == "a <= 1.5 [5.0, 5.0]"
    assert [trees.condition_text(t) for t, *_ in trees.rules(tree, ["a"])] == ["a <= 1.5", "a > 1.5"]


def test_grid_search(spark):
    df = spark.range(60).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    zoo = models.ModelSet("classifier")
    zoo.grid_search("RandomForestClassifier", df, ["a"], "y", {"max_depth": [1, 2]}, folds=2)
    assert zoo.predict("RandomForestClassifier", df).count() == 60
