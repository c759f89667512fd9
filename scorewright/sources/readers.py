"""Readers: tables, delimited text, word vectors, tagged tokens, feature sheets, commented JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.operators.text import squeeze_blanks
from scorewright.plans.specs import FeatureSpec, TableSpec


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A headed CSV file. With a schema there is one pass; without, types are inferred by a second one."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_sample(spark: SparkSession, path: str, schema: str | None = None, features: int = 19, label: int = 20) -> tuple[DataFrame, list[str], str]:
    """A modelling sample: its first columns are features, one later column is the label. Returns table, feature names and label name."""
    df = read_csv(spark, path, schema)
    names = df.columns[:features]
    return df.select(*names, df.columns[label]), names, df.columns[label]


def read_phrases(spark: SparkSession, path: str, text: str = "Phrase") -> DataFrame:
    """A headed TSV file without quoting; runs of blanks in the text become one."""
    df = spark.read.option("header", True).option("quote", "").csv(path, sep="\t")
    return df.withColumn(text, squeeze_blanks(F.col(text)))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, line_no, vec of a file with a word and its numbers on each line; the first of equal words stays. line_no orders the lines."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split("value", " ")
    rows = lines.select(F.get(parts, F.lit(0)).alias("word"), "line_no", F.slice(parts, 2, 1 << 30).cast("array<float>").alias("vec"))
    return rows.groupBy("word").agg(F.min(F.struct("line_no", "vec")).alias("m")).select("word", "m.line_no", "m.vec")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """sentence_id, pos, token, tag of files with a token and its tag on each line and a blank line between sentences.

    Files are read as paragraphs (the reader splits at blank lines), so nothing counts lines across a whole file."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("sentence_id", F.monotonically_increasing_id())
    lines = blocks.select("sentence_id", F.posexplode(F.split(F.regexp_replace("value", r"^\n+|\n+$", ""), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    parts = F.split("line", " ")
    return lines.select("sentence_id", "pos", F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).alias("tag"))


def strip_comments(text: str) -> str:
    """JSON text without // comments; a // inside a string stays."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*', lambda m: m[1] or "", text)


def read_parameters(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.loads(strip_comments(f.read()))


def read_table_spec(path: str) -> TableSpec:
    return TableSpec.from_dict(read_parameters(path))


def feature_specs(sheet: DataFrame, order: str = "line") -> list[FeatureSpec]:
    """Specs from a feature sheet: columns c0 to c4 and a line number.

    c0 names the row's kind (TAG, COMMENT, OBJECTS, FUNCTION, CONDITION_COLS); blanks in c0 and c1 repeat the cell above;
    cells without a quote are upper-cased; a TAG row starts a spec. Condition columns keep their order of first appearance. A
    sheet is a hand-written page, so ordering it in one task and collecting it is bounded."""
    def cell(c: str):
        text = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(text.contains("'"), text).otherwise(F.upper(text)).alias(c)

    rows = sheet.select(order, *map(cell, ["c0", "c1", "c2", "c3", "c4"])).filter(F.concat("c0", "c1", "c2", "c3", "c4") != "")
    w = Window.orderBy(order)
    filled = rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w) for c in ("c0", "c1")})
    blocks = filled.withColumn("starts", ((F.col("c0") == "TAG") & ((F.lag("c0").over(w) != "TAG") | F.lag("c0").over(w).isNull())).cast("int"))
    blocks = blocks.withColumn("block", F.sum("starts").over(w))
    found: dict[int, dict] = {}
    for r in blocks.sort(order).collect():
        spec = found.setdefault(r["block"], {"tag": None, "comment": "", "objects": [], "function": [], "conditions": {}})
        if r["c0"] in ("TAG", "COMMENT"):
            spec[r["c0"].lower()] = r["c1"]
        elif r["c0"] in ("OBJECTS", "FUNCTION"):
            spec[r["c0"].lower()].append(r["c1"])
        elif r["c0"] == "CONDITION_COLS":
            spec["conditions"].setdefault(r["c1"], []).append((r["c2"], r["c3"], r["c4"]))
    return [FeatureSpec.from_dict(s | {"condition_cols": list(s["conditions"].items())}) for s in found.values() if s["tag"]]
