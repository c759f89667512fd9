"""Text preparation: tokens to indices, padding, length-sorted batches, splits, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions.expressions import left_padded
from scorewright.operators.ranges import marks, range_number
from scorewright.session import cut
from scorewright.shipping import ship

#: Items of the rows of one block that looks its items up together.
BLOCK_ITEMS = 1 << 15


def squeeze_blanks(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def vocabulary(words: DataFrame, word: str = "word", order: str = "line_no") -> DataFrame:
    """word, idx: the first line of each word, numbered from 2 in order; 0 and 1 stay free for out-of-vocabulary and padding.

    Numbers are offsets of sorted ranges: no task orders the whole vocabulary."""
    first = words.groupBy(F.col(word).alias("word")).agg(F.min(order).alias("__line"))
    return number_rows(first, "__line", "idx", 2).select("word", "idx")


def number_rows(df: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of a numeric column without ties, in two levels: ranges at approximate quantiles, then places within a range."""
    rows = _ranges(df, order)
    before = _before(rows.groupBy("__part").agg(F.count("*").alias("__size")))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1 + F.col("__before") + start
    return rows.join(F.broadcast(before), "__part").withColumn(out, place.cast("long")).drop("__part", "__before")


def _ranges(df: DataFrame, order: str) -> DataFrame:
    """df with __part, the number of its range."""
    return df.withColumn("__part", range_number(F.col(order), marks(df, F.col(order))))


def _before(sizes: DataFrame) -> DataFrame:
    """__part and __before, the sum of __size over the ranges before; a row for each range."""
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))


def _blockwise(df: DataFrame, key: str, items: str, answers: DataFrame, finish: Callable[[pa.Array, pa.Array, pa.Array], pa.Array], out: str, out_type: str) -> DataFrame:
    """key and, for each row, what finish(flat items, known items, their values) makes of its items, in order.

    Rows lie in blocks of up to BLOCK_ITEMS items (a longer row is a block of its own). A block asks once for each distinct item it holds and
    gets each answer once, so a frequent item is one row a block, never one a place. Null and empty lists become empty ones;
    keys may be null or repeated, a row each. answers: item, value, at most one row an item."""
    ship(df.sparkSession)
    kinds = dict(df.select(key, items).dtypes)
    item_type = kinds[items].removeprefix("array<").removesuffix(">")

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                limit = (sizes[start - 1] if start else 0) + BLOCK_ITEMS
                stop = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
                part = batch.slice(start, stop - start)
                lists = pa.array(part.column(1))
                whole = [pa.array([number], pa.int64()), _one_list(part.column(0)), _one_list(lists), _one_list(pc.unique(lists.flatten()))]
                yield pa.RecordBatch.from_arrays(whole, names=["block", "keys", "items", "wanted"])
                number, start = number + 1, stop

    blocks = cut(df.select(key, items).mapInArrow(cut_blocks, f"block long, keys array<{kinds[key]}>, items array<array<{item_type}>>, wanted array<{item_type}>"))
    known = blocks.select(F.col("block").alias("asker"), F.explode("wanted").alias("item")).join(answers, "item")

    def answer(block: pa.Table, known: pa.Table) -> pa.Table:
        keys, lists = (block.column(c).combine_chunks().flatten() for c in ("keys", "items"))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found = finish(lists.flatten(), known.column("item").combine_chunks(), known.column("value").combine_chunks())
        return pa.table({key: keys, out: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), found)})

    return blocks.drop("wanted").groupBy("block").cogroup(known.groupBy("asker")).applyInArrow(answer, f"`{key}` {kinds[key]}, `{out}` {out_type}")


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, oov: int = 0) -> DataFrame:
    """key, input_ids: each token's index, in order; unknown ones get oov. A row without tokens gets an empty array. The vocabulary may be of any size."""

    def finish(items: pa.Array, known: pa.Array, values: pa.Array) -> pa.Array:
        return pc.fill_null(values.take(pc.index_in(items, value_set=known)), oov)

    return _blockwise(df, key, tokens, vocab.select(F.col("word").alias("item"), F.col("idx").cast("long").alias("value")), finish, "input_ids", "array<long>")


def pad(df: DataFrame, ids: str, size: int, pad_id: int = 0) -> DataFrame:
    return df.withColumn(ids, left_padded(F.col(ids), size, pad_id))


def batches(df: DataFrame, length: str, size: int, ties: list[str]) -> DataFrame:
    """df with batch_id: rows in order of length, then of ties, `size` a batch, the last one takes the remainder; fewer rows than a batch are one.

    Rows are dealt by range of the whole order, ties included, so neither all rows nor those of one length are one task's; ranges start where the rows
    before them end."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(ranges, length, *ties).withColumn("__part", F.spark_partition_id()))
    before = _before(rows.groupBy("__part").agg(F.count("*").alias("__size")))
    total = F.broadcast(rows.agg(F.count("*").alias("__all")))  # one row
    place = F.row_number().over(Window.partitionBy("__part").orderBy(length, *ties)) - 1
    placed = rows.withColumn("__place", place).join(F.broadcast(before), "__part").crossJoin(total)  # a row for each range
    last = F.greatest(F.floor(F.col("__all") / size) - 1, F.lit(0))
    batch = F.least(F.floor((F.col("__before") + F.col("__place")) / size), last).cast("long")
    return placed.withColumn("batch_id", batch).drop("__part", "__place", "__before", "__all")


def pad_batches(df: DataFrame, batch: str, ids: str, pad_id: int = 0) -> DataFrame:
    """Each batch padded on the left to its longest row."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn(ids, left_padded(F.col(ids), longest, pad_id))


def shuffle_batches(df: DataFrame, batch: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(batch), F.lit(seed)), batch)


def split(df: DataFrame, key: str, share: float = 0.7, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the key: the same row always falls on the same side."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    train = hashed < int(share * (1 << 32))
    return df.filter(train), df.filter(~train)


def embed(df: DataFrame, key: str, ids: str, vectors: DataFrame, dims: int) -> DataFrame:
    """key, vectors: the vector of each id, in order; ids without one (0 and 1 among them) get zeros. A row without ids gets an empty array."""

    def finish(items: pa.Array, known: pa.Array, values: pa.Array) -> pa.Array:
        table = np.concatenate([values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.zeros((1, dims), np.float32)])
        place = pc.fill_null(pc.index_in(items, value_set=known), len(known)).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * dims), pa.array(table[place].astype(np.float32).ravel()))

    rows = df.select(key, F.col(ids).cast("array<long>").alias(ids))
    return _blockwise(rows, key, ids, vectors.select(F.col("idx").cast("long").alias("item"), F.col("vec").cast("array<float>").alias("value")), finish, "vectors", "array<array<float>>")


def early_stop(history: list[float], rounds: int) -> bool:
    """True if none of the last `rounds` differences of a validation score is above 0."""
    changes = [b - a for a, b in zip(history, history[1:], strict=False)]
    return len(changes) >= rounds and all(c <= 0 for c in changes[-rounds:])
