"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in doc_id order; a keyed permutation of [0, n) gives each its place in the shuffled order, and
place mod shards and place div shards are its shard and slot. Any row's place can be computed alone, and inverted,
from n and the seed; no order of the whole table is ever materialised.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import Scratch, offsets, part_of, row_of, shuffle_parts

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit finaliser (xor, shift, multiply), the Feistel round function."""
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * 64 + r], np.uint64), 0x9E3779B97F4A7C15)[0]) for r in range(ROUNDS)]


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The places of row numbers below n (or, inverted, the row numbers of places), for arrays of any length.

    The Feistel domain is the square of the least power of two whose square reaches n, under 4 n; a value that lands
    outside [0, n) walks on along its cycle until it is inside, 4 steps on average at most."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _keys(seed)
    x = rows.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: the law is not 'key').

    Shard counts differ by one at most and the slots of a shard run from 0 without a gap. Equal texts are numbered
    like any other rows and may part. Null text: size 16, crc32 of no bytes. Null doc_id: numbered first. Repeated
    rows: each gets its own place (equal rows are interchangeable). Empty table: no rows. Only ids, sizes and
    checksums are sorted, never texts.
    Other columns, whatever their names, are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "narrow")
    keys = ["doc_id", "text_crc32", "size"]
    ranged = narrow.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    ranged = scratch.keep(ranged.withColumn("mid", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(part_of("mid").alias("part")).agg(F.count("*").alias("rows"))
    n = ranged.count()

    @F.pandas_udf("long")
    def place(row):
        return row.__class__(permute(row.to_numpy(), n, seed))

    # one row for each range partition
    numbered = ranged.withColumn("part", part_of("mid")).join(F.broadcast(offsets(counts, "part", "rows", "before")), "part")
    placed = numbered.withColumn("place", place(F.col("before") + row_of("mid")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
