"""Near-duplicate detection with SetSketch registers.

Texts with equal sets of word shingles form a class. Each class has M registers: the minimum over its shingles of an
exponentially distributed hash, on an exponential scale and truncated (the maximum of registers merges sketches). BANDS
bands of ROWS registers propose candidates; the joint likelihood of two register vectors, given both set sizes, estimates their
similarity; what may reach the threshold is verified on the full shingle sets.

Large groups never meet pair by pair. First each member of a band's bucket meets only the bucket's leader; verified
links give components. Only buckets that still hold several components get a second round, in which members meet all
that are in other components, tile by tile. A pair is skipped only if it is in one component already, so the
components are those of all links among candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright.llm.common import Scratch, by_place, row_slices, shuffle_parts, word_hashes

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: SetSketch parameters: base, rate and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Candidates whose estimate is this many standard deviations below the threshold aren't verified.
DEVIATIONS = 5.0
#: Members of a bucket that meet in one tile, and pairs of a leader that are decided beside one copy of its text.
TILE, DEAL = 256, 64
#: Deals of a component's classes when they get its id.
SALTS = 32
#: A key is hot if it holds over 1/HOT_SHARE of a table's rows, so there are fewer than HOT_SHARE hot keys whatever the data. In small tables
#: a key of no more than LEAST_HOT rows isn't.
HOT_SHARE = 500
LEAST_HOT = 20
#: UTF-8 bytes of texts that meet in one tile, on average.
TILE_BYTES = 8 << 20

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its WORDS-word shingles; of all its words as one with fewer; none without words."""
    words, counts = word_hashes([(t or "").encode() for t in texts])
    return [_shingles(tokens) for tokens in np.split(words, np.cumsum(counts)[:-1])] if texts else []


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def _shingles(tokens: np.ndarray) -> np.ndarray:
    if not len(tokens):
        return np.zeros(0, np.uint64)
    span = min(WORDS, len(tokens))
    h = np.full(len(tokens) - span + 1, 0x2545F4914F6CDD1D + span, np.uint64)
    for k in range(span):
        h = (h ^ tokens[k : k + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of sets that aren't empty, a row each."""
    out = np.empty((len(sets), M), np.uint16)
    at = 0
    while at < len(sets):  # runs of sets that stay in the processor's cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        least = np.empty((M, end - at), np.uint64)
        mixed = np.empty_like(joined)
        for m in range(M):
            np.multiply(joined, MULTIPLIERS[m], out=mixed)
            np.minimum.reduceat(mixed, starts, out=least[m])
        uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
        smallest = -np.log1p(-uniform) / RATE
        out[at:end] = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP)
        at = end
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of a union."""
    return np.maximum(a, b)


def bands(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    for r in range(ROWS):
        h = (h ^ sketches[:, r::ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest joint likelihood of two arrays of sketches, given the set sizes.

    With u and v the shares of the sizes in their sum, register a is larger with probability p(u - v J), smaller with
    p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b); the likelihood is unimodal in J and searched by golden section."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = size_a / (size_a + size_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        first, second = p(u - v * j), p(v - u * j)
        return larger * np.log(first) + smaller * np.log(second) + equal * np.log(np.maximum(1 - first - second, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        left, right = high - golden * (high - low), low + golden * (high - low)
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs may reach the threshold: by their sizes (certain), by the number of registers of equal value (half as many deviations
    more), and by the estimate (DEVIATIONS standard deviations)."""
    threshold = PERCENT / 100
    slack = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / a.shape[1])
    out = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    # registers of equal value make nearly all of the likelihood: far too few of them settle a pair without it
    out[out] = (a[out] == b[out]).sum(axis=1) >= a.shape[1] * (threshold - 1.5 * slack)
    some = np.flatnonzero(out)
    if len(some):
        out[some] = estimate(a[some], b[some], size_a[some], size_b[some]) >= threshold - slack
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The link rule on full shingle sets (sorted, distinct)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in row_slices(batches):
        sets = shingle_sets(rows.column(1).to_pylist())
        some = [k for k, s in enumerate(sets) if len(s)]
        sketches = registers([sets[k] for k in some]) if some else np.zeros((0, M), np.uint16)
        keys = bands(sketches).view(np.int64)
        sig, band, name = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        for k, s, b in zip(some, sketches, keys, strict=True):
            sig[k], band[k], name[k] = s.tobytes(), b, hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
            names=[*rows.schema.names, "n_shingles", "class", "sketch", "bands"],
        )


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches and sizes, a, b and salt of those that may be links."""
    for rows in row_slices(batches, 4096):
        left, right = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("left_sketch", "right_sketch"))
        ok = possible(left, right, rows.column("left_n").to_numpy(), rows.column("right_n").to_numpy())
        yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(ok)) for c in ("a", "b", "salt")], names=["a", "b", "salt"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b), the leader's own row (b null) first: one text is held, the others stream past it."""
    held = None
    for rows in row_slices(batches, 64):
        a, b = [], []
        for r in rows.to_pylist():
            if r["b"] is None:
                held = (r["a"], shingles(r["text"]))
            elif held is not None and held[0] == r["a"] and linked(held[1], shingles(r["text"])):
                a.append(r["a"])
                b.append(r["b"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Tile:
    """Members of one tile of a bucket, met by askers one after the other.

    A pair is compared in the first band that both share only, and once; a pair that sketches and sizes leave possible is decided
    on full sets at once, and a link joins the two components here, so later pairs between them are skipped. So a tile
    returns fewer links than it has askers and components, however many pairs are possible."""

    def __init__(self, members: list[dict]) -> None:
        self.sketches = np.frombuffer(b"".join(m["sketch"] for m in members), "<u2").reshape(-1, M)
        self.sizes = np.array([m["n"] for m in members], np.int64)
        self.names = np.array([m["node"] for m in members], np.int64)
        self.texts = [m.get("text") for m in members]
        self.sets: dict[int, np.ndarray] = {}
        self.numbers, self.joined = {}, []  # components met here, and which of them links have joined
        self.group = np.array([self._number(m["component"]) for m in members])
        self.main = np.array([not m["apart"] for m in members])

    def _number(self, component: int) -> int:
        if component not in self.numbers:
            self.numbers[component] = len(self.joined)
            self.joined.append(len(self.joined))
        return self.numbers[component]

    def _root(self, k: int) -> int:
        while self.joined[k] != k:
            self.joined[k] = self.joined[self.joined[k]]
            k = self.joined[k]
        return k

    def near(self, asker: dict) -> np.ndarray:
        """Members in other components that may be linked with the asker and share no earlier band with it."""
        own = self._number(asker["component"])
        sketch = np.frombuffer(asker["sketch"], "<u2")
        meets = self.main | (self.names < asker["node"])  # of two askers only the later asks; members of the main component never ask
        here = np.flatnonzero(meets & (self.group != own))
        here = here[possible(np.broadcast_to(sketch, (len(here), M)), self.sketches[here], np.full(len(here), asker["n"], np.int64), self.sizes[here])]
        if not len(here):
            return here
        shared = (self.sketches[here] == sketch).reshape(len(here), BANDS, ROWS).all(axis=2)
        return here[shared.argmax(axis=1) == asker["band"]]

    def meet(self, asker: dict) -> Iterator[int]:
        """Members that the asker is linked with, one for each component at most."""
        own = self._number(asker["component"])
        mine = None
        for k in self.near(asker).tolist():
            a, b = self._root(own), self._root(int(self.group[k]))
            if a == b:
                continue
            mine = shingles(asker["text"]) if mine is None else mine
            if k not in self.sets:
                self.sets[k] = shingles(self.texts[k])
            if linked(mine, self.sets[k]):
                self.joined[a] = b
                yield int(self.names[k])


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, band, tile, asks): a tile's members, then the askers that meet them. Links."""
    key, members, tile = None, [], None
    for rows in row_slices(batches):
        a, b = [], []
        for r in rows.to_pylist():
            now = (r["bucket"], r["band"], r["tile"])
            if now != key:
                key, members, tile = now, [], None
            if not r["asks"]:
                members.append(r)
                continue
            if not members:
                continue
            tile = tile or _Tile(members)
            for name in tile.meet(r):
                a.append(min(r["node"], name))
                b.append(max(r["node"], name))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted like _crossed's, but without texts, those of a pair that sketches and sizes leave possible."""
    key, members, tile, hit = None, [], None, set()

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([members[k] for k in sorted(hit)], schema)

    for rows in row_slices(batches):
        schema, asking = rows.schema, []
        for r in rows.to_pylist():
            now = (r["bucket"], r["band"], r["tile"])
            if now != key:
                if hit:
                    yield close()
                key, members, tile, hit = now, [], None, set()
            if not r["asks"]:
                members.append(r)
                continue
            if not members:
                continue
            tile = tile or _Tile(members)
            found = tile.near(r)
            if len(found):
                hit.update(found.tolist())
                asking.append(r)
        yield pa.RecordBatch.from_pylist(asking, schema)
    if hit:
        yield close()


def join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right, which has one row a key at most. Rows of hot keys, of which there are under HOT_SHARE, meet right's rows in
    their place; only the others are dealt by key."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.filter(F.col("__n") > max(total / HOT_SHARE, LEAST_HOT)).select(keys)
    few = hot.collect()  # under HOT_SHARE keys by the filter itself
    if not few:
        return left.join(right, keys)
    hot = F.broadcast(left.sparkSession.createDataFrame(few, hot.schema).withColumn("__hot", F.lit(True)))
    marked = left.join(hot, keys, "left")
    here = marked.filter("__hot").drop("__hot").join(F.broadcast(right.join(hot, keys, "left_semi")), keys)
    return here.unionByName(marked.filter("__hot IS NULL").drop("__hot").join(right, keys))


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, component (the least node reachable) of all nodes of links a, b: least labels spread along links, and each
    node then takes its label's label, until nothing changes. Every round is a written table; only counts and hot keys reach the driver.

    A star's centre and a giant component are hot keys, which aren't dealt to one task."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-both")
    now = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), f"{label}-0")
    for step in range(1, 100):
        seen = join_hot(both, now.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = scratch.keep(now.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), f"{label}-near-{step}")
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = scratch.keep(join_hot(near, jump, ["component"]).select("node", "old", F.col("further").alias("component")), f"{label}-{step}")
        scratch.drop(f"{label}-near-{step}")
        now = after.select("node", "component")
        if after.filter("old <> component").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Of candidate pairs a, b, salt, the links. texts: node, text of every node in pairs.

    The pairs of a node a are dealt out by salt; each deal gets one copy of a's text, and members stream past it."""
    members = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    leaders = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = leaders.unionByName(members).repartition(shuffle_parts(scratch.spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return scratch.keep(dealt.mapInArrow(_verified, "a long, b long"), f"{label}-links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """The written rows (doc_id, text, others, n_shingles, class, mid, ..) and, for each class, its component (a node) and component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("others")] if others else []))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("n_shingles long, class binary, sketch binary, bands array<long>").fields])
    sketched = rows.mapInArrow(_sketch, schema)
    sketched = scratch.keep(sketched.withColumn("mid", F.monotonically_increasing_id()), "sketched")
    # equal sets are one class: a group of copies, however large, is one row from here on, named by a row of its own
    known = sketched.filter("class IS NOT NULL").withColumn("bytes", F.octet_length("text").cast("long"))
    classes = known.groupBy("class").agg(F.min("mid").alias("node"), F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")
    sketches = classes.select("node", "n", "sketch")
    buckets = classes.select(F.posexplode("bands").alias("band", "bucket"), "node", "bytes")

    def texts_of(nodes: DataFrame, label: str) -> DataFrame:
        return scratch.keep(sketched.select(F.col("mid").alias("node"), "text").join(nodes, "node", "left_semi"), label)

    leaders = buckets.groupBy("bucket", "band").agg(F.min("node").alias("leader"), F.count("*").alias("members"), F.sum("bytes").alias("bytes")).filter("members > 1")
    leaders = scratch.keep(leaders, "leaders")
    members = scratch.keep(join_hot(buckets.drop("bytes"), leaders, ["bucket", "band"]), "members")
    # the pairs of a leader are dealt out by its buckets' sizes, so no join below has a leader of many as one key
    first = members.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("members").alias("members"))
    first = first.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / DEAL)).alias("salt"))
    left = first.select("a", "salt").distinct().join(sketches.select(F.col("node").alias("a"), F.col("n").alias("left_n"), F.col("sketch").alias("left_sketch")), "a")
    right = first.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("right_n"), F.col("sketch").alias("right_sketch")), "b")
    first = scratch.keep(right.join(left, ["a", "salt"]).mapInArrow(_estimated, "a long, b long, salt long"), "first")
    links = verify(first, texts_of(first.select(F.col("a").alias("node")).union(first.select("b")), "texts"), scratch, "first")
    found = components(links, scratch, "first")

    placed = members.join(found, "node", "left").select("bucket", "band", "members", "bytes", "node", F.coalesce("component", "node").alias("component"))
    placed = scratch.keep(placed, "placed")
    sizes = scratch.keep(placed.groupBy("bucket", "band", "component").agg(F.count("*").alias("n"), F.first("members").alias("total"), F.first("bytes").alias("bytes")), "sizes")
    # a bucket of two has met in full; in larger ones all but the largest component's members ask all others
    open_buckets = sizes.groupBy("bucket", "band").agg(F.count("*").alias("groups"), F.first("total").alias("total"), F.first("bytes").alias("bytes"), F.max(F.struct("n", "component")).alias("main")).filter("groups > 1 AND total > 2")
    tiles = F.greatest(F.ceil(F.col("total") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    open_buckets = scratch.keep(open_buckets.select("bucket", "band", tiles.alias("tiles"), F.col("main.component").alias("main")), "open")
    if not open_buckets.isEmpty():
        there = scratch.keep(join_hot(placed.select("bucket", "band", "node", "component"), open_buckets, ["bucket", "band"]), "there")
        there = there.withColumn("apart", F.col("component") != F.col("main"))
        shown = there.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("asks", F.lit(False))
        asking = there.filter("apart").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("asks", F.lit(True))
        met = shown.unionByName(asking).select("bucket", "band", "tile", "asks", "node", "component", "apart").join(sketches, "node")

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.repartition(shuffle_parts(spark), "bucket", "band", "tile").sortWithinPartitions("bucket", "band", "tile", "asks")

        # sketches meet first; texts are sent only where a pair may be a link
        near = scratch.keep(dealt(met).mapInArrow(_in_reach, met.schema), "near")
        inside = texts_of(scratch.keep(near.select("node").distinct(), "near-nodes"), "texts-2")  # a table of its own: its size is known to the join
        second = scratch.keep(dealt(near.join(inside, "node")).mapInArrow(_crossed, "a long, b long"), "second")
        if not second.isEmpty():
            found = components(links.unionByName(second), scratch, "second")

    # a component of very many classes is dealt out too, so its one row goes along with each deal
    linked = classes.select("node", "doc_id").join(found, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = scratch.keep(linked.join(least, ["component", "salt"]).select("node", "component", "component_id"), "named")
    ids = classes.select("node", "class", "doc_id").join(named, "node", "left")
    alone = F.col("component").isNull()
    ids = ids.select("class", F.coalesce("component", "node").alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return sketched, scratch.keep(ids, "ids")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id among the texts that links reach, kept says that it is the row's own. Null text or
    one without words: no shingles, linked with nothing, its own component. Null doc_id: never a component's id while
    the component has another; kept only if it has none. Repeated rows and ties share a component and are kept or dropped
    together. Texts of any length are taken whole. Empty table: no rows. Other columns, whatever their names, are ignored.

    What can be missed: a pair at the threshold shares no band with probability 5e-6, and a candidate whose likelihood
    estimate lies DEVIATIONS standard deviations below the threshold isn't verified (under 1e-6 of pairs at the threshold).
    Every link that is returned holds on full sets."""
    sketched, ids = _grouped(docs, id_col, text_col, [])
    # a class with many copies has its row on the small side
    out = sketched.select("doc_id", "n_shingles", "class").join(ids.drop("component"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all columns of docs: that of the smallest id (a null id only if there is no other,
    of repeated rows any one). Texts without words are linked with nothing, so their rows all stay. Rows that share an
    id are told apart by their texts. Texts of any length are compared whole. Columns of any names pass through. Empty table: no rows."""
    plain, (id_place, text_place) = by_place(docs, id_col, text_col)
    others = [c for c in plain.columns if c != text_place]
    sketched, ids = _grouped(plain, id_place, text_place, others)
    rows = sketched.filter("class IS NOT NULL").select("mid", "doc_id", "class").join(ids.select("class", "component"), "class")
    stays = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mid")).alias("first")).select(F.col("first.mid").alias("mid"))
    kept = sketched.filter("class IS NOT NULL").join(stays, "mid", "left_semi").unionByName(sketched.filter("class IS NULL"))
    return kept.select(*[F.col("text").cast(plain.schema[c].dataType) if c == text_place else F.col("others").getField(c) for c in plain.columns]).toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
