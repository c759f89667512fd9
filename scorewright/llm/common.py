"""Plumbing shared by the training-data operators: scratch tables, ordered numbering, text batches.

Everything that has to outlive a stage is written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept on one executor, so a lost executor costs a re-run of its tasks only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.shipping import ship

#: Pattern of the white space that all word and text rules here share (ASCII blanks only).
BLANKS = r"[\x20\x09-\x0D]+"
#: Low bits of monotonically_increasing_id() that number the rows of one partition.
ROW_BITS = 33


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a session without the setting (a local test) gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="scorewright-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named tables of one operator run, each written once and read back, under one folder of the shared root."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def keep(self, df: DataFrame, label: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
        """Write df (in folders by the columns `by`) and return the written table: its lineage ends here and it is never computed again."""
        df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        for label in labels:
            delete(self.spark, self.path(label))


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, .. by place, so that no name of it can clash or need quoting, and what these columns are called then."""
    places = [next(k for k, c in enumerate(df.columns) if c.lower() == name.lower()) for name in names]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [f"c{k}" for k in places]


def keep_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of df, all columns, whose text passes; make() gives, in each task, a test of a list of texts."""
    ship(df.sparkSession)
    plain, (text,) = by_place(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for rows in row_slices(batches):
            yield rows.filter(pa.array(passes(rows.column(text).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32(id as text) mod divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def part_of(mid: str) -> Column:
    return F.shiftright(F.col(mid), ROW_BITS)


def row_of(mid: str) -> Column:
    return F.col(mid).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def offsets(parts: DataFrame, part: str, amount: str, name: str) -> DataFrame:
    """Exclusive running totals over partition numbers.

    parts has one row for each partition of a written table, so both the collected rows and the table that
    callers broadcast are bounded by the number of partitions, not by the data."""
    total, rows = 0, []
    for r in parts.select(F.col(part).cast("long"), F.col(amount).cast("long")).sort(part).collect():
        rows.append((r[0], total))
        total += r[1]
    return parts.sparkSession.createDataFrame(rows, f"{part} long, {name} long")


def row_slices(batches: Iterator, rows: int = 256, chars: int = 1 << 22) -> Iterator:
    """Cut Arrow batches into slices of few rows and few megabytes, so that no step holds a whole batch as Python objects."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            size = min(rows, batch.num_rows - start)
            part = batch.slice(start, size)
            while size > 1 and part.get_total_buffer_size() and _slice_bytes(part) > chars:
                size = (size + 1) // 2
                part = batch.slice(start, size)
            yield part
            start += size


def _slice_bytes(part) -> int:
    return sum(column.nbytes for column in part.columns)


#: Bytes that one generation of a memo may hold, by a careful estimate of what an entry takes, and the longest piece it remembers.
MEMO_BYTES = 96 << 20
MEMO_PIECE = 64
ENTRY_BYTES = 220


class PieceCache(dict):
    """Memo of a pure function of a short text piece, bounded by bytes, in two generations: what was used since the last
    turn survives it. Pieces over MEMO_PIECE long are computed each time, so a text without blanks leaves nothing behind."""

    def __init__(self, make: Callable, owner: str = "", size: int = MEMO_BYTES) -> None:
        super().__init__()
        self.make, self.size, self.old, self.held = make, size, {}, 0
        _memos.setdefault(owner, []).append(self)

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self.remember(piece, value)
        return value

    def remember(self, piece, value) -> None:
        if len(piece) > MEMO_PIECE:
            return
        if self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[piece] = value
        self.held += ENTRY_BYTES + len(piece) + len(value)

    def release(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


_memos: dict[str, list[PieceCache]] = {}


def only(owner: str) -> None:
    """Release this process's memos of all other owners: a reused Python worker keeps none of an earlier stage's."""
    for name, memos in _memos.items():
        if name != owner:
            for memo in memos:
                memo.release()


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTERS = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Bytes of text that are hashed at once, as they stay in the processor's cache.
_RUN = 1 << 15


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_FORTH, _BACK = _powers(_STEP, _RUN * 2), _powers(_STEP_BACK, _RUN * 2)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one text after the other, and each text's number of words.

    Words are stretches without ASCII white space, A-Z in lower case. A word's hash is a polynomial of its bytes, taken as
    a difference of running sums, so no word ever becomes a Python object."""
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _RUN):
            size += len(texts[end]) + 1
            end += 1
        found = _run_hashes(texts[at:end])
        hashes.append(found[0])
        counts.append(found[1])
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def _run_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(data)
    forth, back = (_FORTH[:n], _BACK[:n]) if n <= len(_FORTH) else (_powers(_STEP, n), _powers(_STEP_BACK, n))
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    start, stop = edge[::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[_LOWER[data]] * forth, out=total[1:])
    h = (total[stop] - total[start]) * back[start]
    h ^= (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return h, np.diff(np.searchsorted(start, ends), prepend=0)
