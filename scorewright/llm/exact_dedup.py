"""Exact dedup with a persistent digest index (DataFrame and SQL functions only).

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is reduced to one row for
each digest, anti-joined with the index by a sort-merge join that reads the index without a shuffle, and what is new
is appended. Texts never leave the scan: only digests and ids are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scorewright.llm.common import BLANKS, Scratch, by_place, delete, shared_root, shuffle_parts

#: A digest is hot if it holds over 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot digests whatever the data.
HOT_SHARE = 500
#: Batches, in ascending ids, that a table without an index is taken in.
BATCHES = 4


def digest(text_col: str = "text") -> Column:
    """SHA-256 (binary) of the normalised text; a null text counts as the empty text."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, with the id that stays for each of them."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_parts(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def create(self, id_type: str) -> None:
        """The empty table, so that the first batch takes the same way as all later ones."""
        columns, buckets = f"sha BINARY, keep_id {id_type}", f"CLUSTERED BY (sha) SORTED BY (sha) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet {buckets} LOCATION '{shared_root(self.spark)}/{self.table}'")

    def append(self, groups: DataFrame) -> None:
        """Add groups (sha, keep_id) whose digests the index does not hold yet. Rows are dealt as the buckets are, so each append adds one file to a bucket."""
        new = groups.select("sha", "keep_id")
        if not self.exists():
            self.create(dict(new.dtypes)["keep_id"])
        new = new.join(self.rows().hint("merge"), "sha", "left_anti")
        (
            new.repartition(self.buckets, "sha").write.mode("append").format("parquet").option("path", f"{shared_root(self.spark)}/{self.table}")
            .bucketBy(self.buckets, "sha").sortBy("sha").saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, f"{shared_root(self.spark)}/{self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A digest that the index already holds keeps the id noted there, so the rows of the new batch go. group_size counts the rows of
    docs. New digests are appended to the index; a repeated run adds nothing. Without an index one is made for this call and dropped, and
    docs come in BATCHES batches in ascending ids (one, if ids aren't numbers; null ids come last), each anti-joined with those
    before it, so the smallest doc_id of a group stays.

    Null text: the empty text. Null doc_id: never chosen while its group has another id; a group with null ids only
    keeps them all (keep_id null). Repeated rows: equal ids are one document, so all its rows are kept or dropped
    together. Texts of any length are hashed whole. Empty table: no rows. Other columns, whatever their names, are ignored."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    known = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("sha")), "digests")
    groups = _groups(known, index, scratch)
    rows = known.count()
    hot = F.broadcast(groups.filter(F.col("group_size") > rows / HOT_SHARE))  # under HOT_SHARE rows by the filter itself
    cold = groups.filter(F.col("group_size") <= rows / HOT_SHARE)
    marked = known.join(hot, "sha", "left")
    out = marked.filter("group_size IS NOT NULL").unionByName(marked.filter("group_size IS NULL").select("doc_id", "sha").join(cold, "sha"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _groups(known: DataFrame, index: DigestIndex | None, scratch: Scratch) -> DataFrame:
    """sha, keep_id (from the index) and group_size of each digest of the written rows doc_id, sha."""
    passing = index is None
    index = index or DigestIndex(scratch.spark)
    cuts = _cuts(known, BATCHES) if passing else []
    number = F.lit(0)
    if cuts:
        number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))))
    # one row for each digest and batch: a group of many copies is gone before any join
    batches = known.withColumn("batch", number).groupBy("sha", "batch").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("rows"))
    batches = scratch.keep(batches, "batches")
    for k in range(len(cuts) + 1):
        index.append(batches.filter(F.col("batch") == k))
    sizes = batches.groupBy("sha").agg(F.sum("rows").alias("group_size"))
    groups = scratch.keep(sizes.join(index.rows().hint("merge"), "sha").select("sha", "keep_id", "group_size"), "kept")
    if passing:
        index.drop()
    return groups


def _cuts(known: DataFrame, batches: int) -> list:
    """Inner edges of batches of about equal numbers of ids; none for ids that aren't numbers."""
    if not isinstance(known.schema["doc_id"].dataType, NumericType):
        return []
    found = known.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(found or []))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row of each group of equal texts, with all columns of docs: that of the smallest id (a null id only if there is no
    other, of repeated rows any one); none of a group that a given index knows by another id. Null text: the empty text. Texts of any
    length are hashed whole. Columns of any names pass through. Empty table: no rows.

    Rows are written once, with numbers. The row of each digest is the least in partial minima, so neither a row that is repeated very often nor
    its text is gathered anywhere, and it stays if its id is the one that the index holds."""
    scratch = Scratch(docs.sparkSession, "keep-first")
    plain, (id_place, text_place) = by_place(docs, id_col, text_col)
    numbered = scratch.keep(plain.select("*", digest(text_place).alias("sha"), F.monotonically_increasing_id().alias("number")), "numbered")
    rows = numbered.select(F.col(id_place).alias("doc_id"), "sha", "number")
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")).alias("row"))
    groups = _groups(rows.drop("number"), index, scratch)
    stays = first.join(groups, "sha").filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id"))).select("row.number")
    return numbered.join(stays, "number", "left_semi").select(plain.columns).toDF(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
