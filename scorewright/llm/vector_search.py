"""Exact top-k search by vector-approximation files.

Candidates lie in blocks. For each block every dimension is cut into 2^BITS equal cells; a scan of the cell numbers
gives, for every query of a query block, an upper and a lower bound of each inner product. Exact vectors are read in the
order of the bounds, best first, until the k-th exact score beats every bound that is left. Query blocks are dealt to
candidate blocks, so neither side is broadcast or gathered; each pair of blocks returns k rows a query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.common import Scratch, shuffle_parts

BITS = 4
#: Candidates of a block at most; small tables are cut into enough blocks for all tasks, of LEAST_ROWS or more.
BLOCK_ROWS = 65_536
LEAST_ROWS = 2048
QUERY_ROWS = 512
#: Bounds that are held at once.
CELLS = 1 << 20


class VaBlock:
    """Approximation and exact vectors (int64, rows by dimensions) of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(axis=0).astype(np.float64), vectors.max(axis=0).astype(np.float64)
        self.half = np.maximum((high - low) / (1 << BITS), 1e-9) / 2
        self.low = low
        self.cells = np.minimum((vectors - low) / (2 * self.half), (1 << BITS) - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products, with room for floating-point error."""
        middle = self.low + (2 * self.cells + 1) * self.half
        about = queries @ middle.T
        size = np.abs(queries)
        spread = size @ self.half + 1e-9 * (1 + size @ np.abs(middle).max(axis=0))
        return about - spread[:, None], about + spread[:, None]

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """For each query: its id, and ids and exact scores of its k best (ties to smaller ids), the query itself left out."""
        exact_dtype = np.int64 if _fits(queries, self.vectors) else object
        turn = max(1, CELLS // len(self.ids))
        for at in range(0, len(queries), turn):
            yield from self._top(query_ids[at : at + turn], queries[at : at + turn], k, exact_dtype)

    def _top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exact_dtype: type) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        low, high = self.bounds(queries.astype(np.float64))
        own = query_ids[:, None] == self.ids[None, :]
        low[own], high[own] = -np.inf, -np.inf
        for q in range(len(queries)):
            # the k-th best lower bound already excludes most approximations
            kth = np.partition(low[q], -k)[-k] if len(self.ids) >= k else -np.inf
            order = np.flatnonzero((high[q] >= kth) & ~own[q])
            order = order[np.argsort(-high[q][order], kind="stable")]
            found: list[tuple[int, int]] = []
            query = queries[q].astype(exact_dtype)
            for at in range(0, len(order), 16):
                if len(found) >= k and high[q][order[at]] < -found[k - 1][0]:
                    break  # no bound that is left reaches the k-th score
                rows = order[at : at + 16]
                scores = self.vectors[rows].astype(exact_dtype) @ query
                found = sorted(found + [(-int(s), int(i)) for s, i in zip(scores, self.ids[rows], strict=True)])[:k]
            yield int(query_ids[q]), [i for _, i in found], [-s for s, _ in found]


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**62


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, dims and v (array of floor(scale * x)); vectors that are null, or hold null or non-finite components, are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    rows = vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dims"), whole.alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: exact best k of each row whose id is divisible by `every`, against all other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Only vectors of
    equal length have a score. A vector without components scores 0. Rows that share the query's id are not its candidates; a
    repeated query id is one query for each distinct vector. Ties: the smaller vec_id, repeated rows each count. A score outside
    a long is held at the long's limit. Empty table: no rows. Other columns, whatever their names, are ignored.

    Work is queries times rows, in blocks: a stated query set against all rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-search")
    whole = scratch.keep(quantise(vectors, id_col, vector_col, scale).filter("id IS NOT NULL"), "whole")
    sizes = {r["dims"]: (r["n"], r["q"]) for r in whole.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}

    def block_rows(n: int) -> int:
        return min(BLOCK_ROWS, max(LEAST_ROWS, math.ceil(n / shuffle_parts(spark))))

    # dims -> numbers of blocks; one row for each vector length
    plan = spark.createDataFrame([(d, max(1, math.ceil(n / block_rows(n))), max(1, math.ceil(q / QUERY_ROWS))) for d, (n, q) in sizes.items()], "dims int, blocks int, query_blocks int")
    placed = whole.join(F.broadcast(plan), "dims")
    parts = F.abs(F.xxhash64("id"))
    candidates = placed.select("dims", F.expr("pmod(xxhash64(id, 7), blocks)").cast("int").alias("block"), F.lit(-1).alias("part"), "id", "v", F.lit(0).cast("long").alias("copy"))
    asked = placed.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = asked.select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(parts, F.col("query_blocks")).cast("int").alias("part"), "id", "v", F.xxhash64("v").alias("copy"))
    schema = "query_id long, vec_id long, score long, copy long"
    n_parts = max(shuffle_parts(spark), min(20_000, sum(math.ceil(n / block_rows(n)) for n, _ in sizes.values())))
    dealt = candidates.unionByName(asked).repartition(n_parts, "dims", "block").sortWithinPartitions("dims", "block", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = part = None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        copies: list[int] = []
        block = None

        def ask() -> pa.RecordBatch | None:
            if block is None or part in (None, -1) or not ids:
                return None
            out: list[list] = [[], [], [], []]
            for number, (query, found, scores) in enumerate(block.top(np.concatenate(ids), np.concatenate(rows), k)):
                out[0] += [query] * len(found)
                out[1] += found
                out[2] += [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
                out[3] += [copies[number]] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["query_id", "vec_id", "score", "copy"])

        for batch in batches:
            dims, blocks, parts_ = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(parts_) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = (int(dims[a]), int(blocks[a]))
                if now != key or int(parts_[a]) != part:
                    if key is not None and part == -1:
                        block = VaBlock(np.concatenate(ids), np.concatenate(rows))
                    elif (answer := ask()) is not None:
                        yield answer
                    if now != key:
                        block = None
                    key, part, ids, rows, copies = now, int(parts_[a]), [], [], []
                copies += batch.column(5).slice(a, b - a).to_pylist()
                ids.append(batch.column(3).slice(a, b - a).to_numpy())
                rows.append(batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, now[0]))
        if (answer := ask()) is not None:
            yield answer

    found = dealt.mapInArrow(search, schema)
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
