"""The trie of conversations that share their first turns, built as a Patricia tree over sorted sequences.

A conversation is the sequence of its turns' digests. Equal sequences become one item; items are sorted by range, and each range makes the
points of its own part of the tree, branches, ends and leaves, from the lengths that neighbours share. Numbers of a subtree are added up
from point to point; the nodes inside an edge have the members of the point below them, and their saved tokens are suffix sums along the edge.

A node that two ranges share lies on the path of a range's first or last item. Each range reports its part of these few nodes,
one row each, and the parts are added up by the node's digest, so no task ever sees more than one range and no subtree is one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.common import Scratch, by_place, shuffle_parts

#: Letters of a turn's digest (hexadecimal, 128 bits).
WIDTH = 32
#: Ids in one piece of a list of members, and turns that a range of sorted sequences should hold.
PIECE = 1024
RANGE_TURNS = 1 << 20
#: Characters of a text by which ranges of turns are told apart; inside a range whole texts are compared.
KEY_CHARS = 64

EDGE_SCHEMA = "conv_id long, top int, parent string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saves array<long>, ends string"
SHARED_SCHEMA = "node string, parent string, depth int, pid int, side string, tokens long, n_convs long, conv_id long, n_leaves long, n_children long, saved_tokens long, ends string"
NONE_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, seq (digests of all turns in order) and tokens (code points of each) of rows conv_id, turn, role, text.

    Turns are ordered by range over the whole table, so a conversation of any size is sorted by many tasks; texts go no further."""
    near = F.substring("text", 1, KEY_CHARS)
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ordered = rows.repartitionByRange(shuffle_parts(scratch.spark), *order, near).sortWithinPartitions(*order, "text")
    label = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = scratch.keep(ordered.select("conv_id", F.monotonically_increasing_id().alias("at"), F.substring(F.sha2(label, 256), 1, WIDTH).alias("digest"), F.length("text").alias("size")), "turns")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "size"))).alias("t"))
    return scratch.keep(listed.select("conv_id", F.array_join("t.digest", "").alias("seq"), F.col("t.size").alias("tokens")), "sequences")


def rebuilt(found: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Each sequence with its first h turns taken from the conversation conv_id - conv_id % block; h = crc32(conv_id) % heads."""
    base = found.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, (heads - 1) * WIDTH).alias("head"), F.slice("tokens", 1, heads - 1).alias("head_tokens"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = found.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block}).join(base, "base", "left")
    seq = F.concat(F.coalesce(F.expr(f"substring(head, 1, h * {WIDTH})"), F.lit("")), F.expr(f"substring(seq, h * {WIDTH} + 1)"))
    tokens = F.concat(F.coalesce(F.expr("slice(head_tokens, 1, h)"), F.expr("CAST(array() AS array<int>)")), F.expr("slice(tokens, h + 1, greatest(size(tokens) - h, 0))"))
    return joined.select("conv_id", seq.alias("seq"), tokens.alias("tokens"))


def _members(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """For each distinct sequence: its conversations' number, the smallest one, and SHA-256 of their ascending ids.

    A digest of a list can only be computed from its start to its end, so one task reads a group's ids; but ids reach it ordered
    and as texts of PIECE ids each, written by the ranges that sorted them, and it holds one piece at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, held, key, ids, no = TaskContext.get().partitionId(), [], None, [], 0

        def close() -> None:
            held.append({"key": key, "pid": pid, "no": no, "n": len(ids), "least": ids[0], "ids": ",".join(map(str, ids))})

        schema = pa.schema([("key", pa.string()), ("pid", pa.int32()), ("no", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(ids) == PIECE:
                    if ids:
                        close()
                    key, ids, no = k, [], no + 1
                ids.append(c)
            yield pa.RecordBatch.from_pylist(held, schema)
            held.clear()
        if ids:
            close()
            yield pa.RecordBatch.from_pylist(held, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "copies", "conv_id", "ends"]
        key = None
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        lines.append((key, n, least, sha.hexdigest()))
                    key, n, least, sha = r["key"], 0, r["least"], hashlib.sha256()
                elif n:
                    sha.update(b",")
                sha.update(r["ids"].encode())
                n += r["n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 4, kinds, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, n, least, sha.hexdigest()), kinds, strict=True)], names=names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    parts = shuffle_parts(scratch.spark)
    keyed = convs.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    listed = scratch.keep(keyed.mapInArrow(pieces, "key string, pid int, no long, n long, least long, ids string"), "pieces")
    return listed.repartition(parts, "key").sortWithinPartitions("key", "pid", "no").mapInArrow(digests, "key string, copies long, conv_id long, ends string")


def _shared(a: str, b: str) -> int:
    """Turns that two sequences have in common at their start."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _name(seq: str, depth: int) -> str:
    return hashlib.sha256(seq[: depth * WIDTH].encode()).hexdigest()[:WIDTH]


class _Point:
    """An open point: the aggregates of what has been closed below it, and edges that wait for its smallest member."""

    def __init__(self, depth: int, sides: str = "") -> None:
        self.depth, self.sides = depth, sides
        self.n, self.least, self.leaves, self.children, self.saved, self.ends, self.waiting = 0, None, 0, 0, 0, NONE_ENDS, []

    def take(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Patricia:
    """The compressed tree of one range of sorted, distinct sequences, of which `before` turns of the first and `after` turns of the last
    are shared with the neighbouring ranges (after: -1 if there is no next one). edges and shared are rows of EDGE_SCHEMA and SHARED_SCHEMA."""

    def __init__(self, pid: int, before: int, after: int) -> None:
        self.pid, self.edges, self.shared = pid, [], []
        self.after = after
        self.open = [_Point(d, "first") for d in range(before + 1)]

    def build(self, items: list[dict]) -> None:
        last = len(items) - 1
        lengths = [len(i["seq"]) // WIDTH for i in items]
        common = [0, *(_shared(a["seq"], b["seq"]) for a, b in zip(items, items[1:]))]
        for k, item in enumerate(items):
            if k:
                self._close(common[k], items[k - 1])
            depth = lengths[k]
            if self.open[-1].depth < depth:
                self.open.append(_Point(depth))
            if k == last:
                self._mark()
            point = self.open[-1]
            point.take(item["copies"], item["conv_id"])
            point.ends = item["ends"]
            point.leaves += depth > (common[k + 1] if k < last else self.after)  # the next sequence doesn't go on from here
        if items:
            self._close(-1, items[-1])

    def _mark(self) -> None:
        """The last item's path has a point of its own for each turn shared with the next range."""
        known = {p.depth: p for p in self.open}
        for depth in range(max(0, self.after) + 1):
            point = known.setdefault(depth, _Point(depth))
            point.sides = "both" if point.sides == "first" else "last"
        self.open = [known[d] for d in sorted(known)]

    def _close(self, depth: int, item: dict) -> None:
        """Close all points of the item's path below a depth; where they leave it there is a branch."""
        while self.open[-1].depth > depth:
            point = self.open.pop()
            if depth >= 0 and self.open[-1].depth < depth:
                self.open.append(_Point(depth))
            above = self.open[-1] if self.open else None
            if point.sides:
                self._report(point, item)
            else:
                self._edge(point, above, item)
            if above:
                above.take(point.n, point.least)
                above.leaves += point.leaves
            if not self.open:
                return

    def _report(self, point: _Point, item: dict) -> None:
        d, seq = point.depth, item["seq"]
        self.shared.append((_name(seq, d), _name(seq, d - 1) if d else None, d, self.pid, point.sides, item["tokens"][d - 1] if d else 0, point.n, point.least, point.leaves, point.children, point.saved, point.ends))
        for edge in point.waiting:
            self.edges.append((*edge[:2], _name(seq, d), None, *edge[4:]))
        if self.open:
            self.open[-1].saved += point.saved

    def _edge(self, point: _Point, above: _Point, item: dict) -> None:
        """The nodes after `above` up to the point. They have the point's members; what each saves is a suffix sum along the edge."""
        tokens = np.array(item["tokens"][above.depth : point.depth], np.int64)
        saves = (point.saved + (point.n - 1) * np.cumsum(tokens[::-1])[::-1]).tolist()
        above.waiting.append((point.least, above.depth + 1, None, None, point.n, point.children, point.leaves, saves, point.ends))
        above.children += 1
        above.saved += saves[0]
        for edge in point.waiting:
            self.edges.append((*edge[:2], None, point.least, *edge[4:]))


def trie(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, seq, tokens), conv_ids being distinct."""
    spark = scratch.spark
    keyed = scratch.keep(convs.withColumn("key", F.substring(F.sha2("seq", 256), 1, WIDTH)), "keyed")
    members = scratch.keep(_members(keyed, scratch), "members")
    turns = keyed.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    ranges = max(shuffle_parts(spark), turns // RANGE_TURNS)
    items = members.drop("key").join(keyed.drop("key"), "conv_id")
    items = items.repartitionByRange(ranges, "seq").sortWithinPartitions("seq").withColumn("pid", F.spark_partition_id())
    items = scratch.keep(items, "items")
    ends = items.groupBy("pid").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).sort("pid").collect()  # two sequences of each range
    cut = [0, *(_shared(a["last"], b["first"]) for a, b in zip(ends, ends[1:])), -1]
    bounds = {r["pid"]: (cut[k], cut[k + 1]) for k, r in enumerate(ends)}
    schema = f"{EDGE_SCHEMA}, shared struct<{SHARED_SCHEMA.replace(' ', ':').replace(',:', ',')}>"

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        tree = Patricia(rows[0]["pid"], *bounds[rows[0]["pid"]])
        tree.build(rows)
        names = [f.split()[0] for f in EDGE_SCHEMA.split(", ")]
        lines = [dict(zip(names, e, strict=True)) for e in tree.edges]
        names = [f.split()[0] for f in SHARED_SCHEMA.split(", ")]
        lines += [{"shared": dict(zip(names, s, strict=True))} for s in tree.shared]
        return pa.Table.from_pylist(lines, schema=arrow)

    arrow = _arrow_schema()
    built = scratch.keep(items.groupBy("pid").applyInArrow(build, schema), "built")
    parts = built.filter("shared IS NOT NULL").select("shared.*")
    nodes = scratch.keep(_joined(parts), "shared")
    owner = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    edges = built.filter("shared IS NULL").drop("shared").join(owner, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    inner = edges.select("*", F.posexplode("saves").alias("place", "saved_tokens"), (F.size("saves") - 1).alias("bottom"))
    at_point = F.col("place") == F.col("bottom")
    inside = inner.select(
        "conv_id", (F.col("top") + F.col("place")).cast("long").alias("depth"), F.when(F.col("place") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_point, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.when(at_point, F.col("ends")).otherwise(F.lit(NONE_ENDS)).alias("ends_sha256"),
    )
    top = nodes.join(owner, "parent", "left").select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return inside.unionByName(top)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def fields(schema: str) -> list[pa.Field]:
        return [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]

    return pa.schema([*fields(EDGE_SCHEMA), pa.field("shared", pa.struct(fields(SHARED_SCHEMA)))])


def _joined(parts: DataFrame) -> DataFrame:
    """Nodes shared between ranges, from each range's part of them.

    What the shared nodes themselves save is added up along each range's two paths: a node counts in the first range that has it, which
    has all nodes above it too."""
    ends = F.max(F.when(F.col("ends") != NONE_ENDS, F.col("ends")))
    whole = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("pid").alias("home"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("n_children").alias("n_children"), F.sum("saved_tokens").alias("inner"), F.first("tokens").alias("tokens"), F.coalesce(ends, F.lit(NONE_ENDS)).alias("ends"),
    )
    own = F.when(F.col("home") == F.col("pid"), (F.col("whole_n") - 1) * F.col("tokens")).otherwise(F.lit(0))
    paths = parts.select("node", "pid", "side", "depth").join(whole.select("node", "home", "tokens", F.col("n_convs").alias("whole_n")), "node").withColumn("own", own)
    below = Window.partitionBy("pid", "side").orderBy(F.desc("depth"))
    other = F.sum(F.when(F.col("side") != "both", F.col("own")).otherwise(F.lit(0))).over(Window.partitionBy("pid"))
    summed = F.sum("own").over(below) + F.when(F.col("side") == "both", other).otherwise(F.lit(0))
    saved = paths.withColumn("part", summed).groupBy("node").agg(F.sum("part").alias("along"))
    children = whole.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    found = whole.join(saved, "node").join(children, "node", "left")
    return found.select("node", "parent", "depth", "conv_id", "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves", (F.col("inner") + F.col("along")).alias("saved_tokens"), "ends")


def prefix_trie(conversations: DataFrame, change: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role and text); conv_id is its smallest member. change: whether sequences are
    rebuilt by `rebuilt` first.

    Null role or text: the empty one. Null turn: before all others; equal turns are ordered by role, then by text, and a repeated row is a
    turn of its own. Rows with a null conv_id take no part. Empty and very long texts are turns like others, hashed whole.
    Empty table: no rows. Other columns, whatever their names, are ignored. A conversation's digests, 36 bytes a turn, are one row."""
    scratch = Scratch(conversations.sparkSession, "trie")
    plain, (conv, turn, role, text) = by_place(conversations, conv_col, turn_col, role_col, text_col)

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = plain.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    found = sequences(rows, scratch)
    return trie(rebuilt(found) if change else found, scratch)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), change=True)


OP12_SQL = r"""
WITH filled AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS k FROM filled),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(d)::BIGINT FOR d IN string_split(c::VARCHAR, '')]),
  LAMBDA acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), LAMBDA v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT crc.c, 0 AS side, k, role, text FROM crc JOIN own ON own.c = crc.c - crc.c % 100 AND own.k <= crc.h
  UNION ALL SELECT crc.c, 1, k, role, text FROM crc JOIN own ON own.c = crc.c AND own.k > crc.h),
placed AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY side, k) AS depth FROM turns),
paths AS (SELECT c, depth, length(text) AS size, list([role, text]) OVER (PARTITION BY c ORDER BY depth) AS path FROM placed UNION ALL SELECT c, 0, 0, [] FROM crc),
long AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
nodes AS (SELECT path, depth, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = (SELECT l.depth FROM long l WHERE l.c = paths.c)), '')) AS ends_sha256 FROM paths GROUP BY path, depth),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT n.path AS below, n.path[:d] AS path FROM nodes n, range(0, n.depth + 1) AS r(d)),
sums AS (SELECT above.path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens FROM above JOIN nodes n ON n.path = above.below LEFT JOIN children k ON k.path = n.path GROUP BY above.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children k ON k.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""
