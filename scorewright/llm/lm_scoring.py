"""Language-model scoring by a weighted backoff automaton whose n-gram counts come from all training documents.

Model, of order 3: p1(w) = (c(w) + 1) / (N + V + 1), p2(w | h) = (c(h w) + MU[0] p1(w)) / (c(h) + MU[0]) and p3(w | g h) =
(c(g h w) + MU[1] p2(w | h)) / (c(g h) + MU[1]). Its states are the observed histories: the root, each word, each pair of words.
A state has an arc for each word observed after it, weighted with the logarithm of that word's probability and leading to the
longest observed history, and a failure arc to the history without its first word, weighted with what smoothing leaves to
it. The root has an arc for every word. One left-to-right traversal carries the state and adds up weights; many texts are
traversed side by side. Probabilities over V words and one unknown word sum to 1.

The model grows with the corpus, so no task ever holds all of it. Documents are cut into blocks of some megabytes. A block
asks the shards of the n-gram space for the counts of its own distinct n-grams and contributes its training counts in the
same message, as packed arrays; the answers make exactly the part of the automaton that the block's texts can reach. Of the
triples only those are asked for whose both pairs occur in another block too: the others occur in one alone, so it knows their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import Scratch, id_remainder, row_slices, word_hashes

#: Weights of the next shorter history, for pairs and for triples.
MU = (256.0, 16.0)
#: UTF-8 bytes of text after which a block is closed, and n-grams that a shard should hold.
BLOCK_BYTES = 6 << 20
SHARD_NGRAMS = 1_500_000
LEAST_SHARDS = 64
#: Beyond so many shards messages take two hops, over groups of shards and of blocks, so that none shrinks to a few n-grams.
DIRECT_SHARDS = 4096
#: Tokens that one lane of a traversal reads; longer texts are read by several lanes, each of which first reads the history before it.
LANE = 256
#: Ids of the end of a text and of the state before its first word; words hash elsewhere with overwhelming odds.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ASK_SCHEMA = "block long, part int, n int, keys binary, counts binary"
ANSWER_SCHEMA = "block long, part int, n int, tokens long, totals binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class BlockNgrams:
    """The tokens of a block's texts, START before and END after each, and the n-grams that end at each of them.

    keys[k] has the distinct n-grams of order k + 1, ascending (the lowest bit of a single's key is 0, of a pair's 1), where[k]
    each position's place among them (-1 if its text has no such n-gram), some[k] a position of each of them."""

    def __init__(self, texts: list[bytes], orders: int = 3) -> None:
        words, counts = word_hashes(texts)
        self.lengths = counts + 1
        spans = counts + 2
        self.begin = np.cumsum(spans) - spans
        tokens = np.empty(int(spans.sum()), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.begin] = inner[self.begin + spans - 1] = False
        tokens[inner], tokens[self.begin], tokens[self.begin + spans - 1] = words, START, END
        offset = np.arange(len(tokens)) - np.repeat(self.begin, spans)
        one = np.uint64(1)
        self.keys, self.where, self.some = [], [], []
        before, pair = np.roll(tokens, 1), None
        for order in range(orders):
            if order == 0:
                h = _mix(tokens) & ~one
            elif order == 1:
                pair = h = _mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens) | one
            else:
                h = _mix(np.roll(tokens, 2) * np.uint64(0xD1342543DE82EF95) + pair)
            has = np.flatnonzero(offset >= max(1, order))
            keys, some, place = np.unique(h[has], return_index=True, return_inverse=True)
            where = np.full(len(tokens), -1)
            where[has] = place
            self.keys.append(keys)
            self.where.append(where)
            self.some.append(has[some])
        self.texts = np.repeat(np.arange(len(texts)), spans)

    def training_counts(self, training: np.ndarray, order: int) -> np.ndarray:
        where = self.where[order]
        return np.bincount(where[(where >= 0) & training[self.texts]], minlength=len(self.keys[order]))

    def low_orders(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of singles and pairs together, ascending, and the order that made them so."""
        joined = np.concatenate(self.keys[:2])
        order = np.argsort(joined)
        return joined[order], order

    def spread_low(self, totals: np.ndarray) -> list[np.ndarray]:
        """Totals in the order of low_orders(), by order of n-gram."""
        out = np.empty_like(totals)
        out[self.low_orders()[1]] = totals
        return [out[: len(self.keys[0])], out[len(self.keys[0]) :]]

    def open_triples(self, outside: np.ndarray) -> np.ndarray:
        """Which triples may occur in another block: those whose both pairs do."""
        return outside[self.where[1][self.some[2] - 1]] & outside[self.where[1][self.some[2]]]


class Automaton:
    """The states and arcs that a block's texts can reach, from corpus-wide counts of the block's n-grams.

    State 0 is the root, 1 + w the word w (after the last word: START), the pairs follow. Arcs of words and pairs lie sorted by
    state and word in arc_keys; the root's are indexed by word."""

    def __init__(self, grams: BlockNgrams, counts: list[np.ndarray], total: int, types: int) -> None:
        single, pair, triple = (c.astype(np.float64) for c in counts)
        words = len(single)
        self.stride = words + 1
        history = np.append(single, single[grams.where[0][grams.begin + grams.lengths]][:1])  # texts start as often as they end
        head = grams.where[0][grams.some[1] - 1]
        head = np.where(head < 0, words, head)
        tail = grams.where[0][grams.some[1]]
        first = 1 + self.stride  # the first pair's state
        p1 = (single + 1) / (total + types + 1)
        p2 = (pair + MU[0] * p1[tail]) / (history[head] + MU[0])
        inner, last = grams.where[1][grams.some[2] - 1], grams.where[1][grams.some[2]]
        p3 = (triple + MU[1] * p2[last]) / (pair[inner] + MU[1])
        self.root_weight, self.root_next = np.log10(p1), np.where(single > 0, 1 + np.arange(words), 0)
        pairs, triples = np.flatnonzero(pair > 0), np.flatnonzero(triple > 0)
        keys = np.concatenate([(1 + head[pairs]) * self.stride + tail[pairs], (first + inner[triples]) * self.stride + tail[last[triples]]])
        order = np.argsort(keys)
        self.arc_keys = keys[order]
        self.arc_weight = np.log10(np.concatenate([p2[pairs], p3[triples]]))[order]
        self.arc_next = np.concatenate([first + pairs, first + last[triples]])[order]
        self.fail_next = np.concatenate([np.zeros(first, np.int64), 1 + tail])
        self.fail_weight = np.log10(np.concatenate([[1.0], MU[0] / (history + MU[0]), MU[1] / (pair + MU[1])]))
        self.start = 1 + words if history[words] > 0 else 0

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many traversals: the states after their words, and the weights of the arcs and failure arcs taken."""
        after, weight, now = np.empty_like(state), np.zeros(len(state)), state.copy()
        todo = np.arange(len(state))
        while len(todo):
            at, here = now[todo], word[todo]
            key = at * self.stride + here
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1) if len(self.arc_keys) else np.zeros(len(todo), np.int64)
            hit = (at > 0) & (self.arc_keys[arc] == key) if len(self.arc_keys) else np.zeros(len(todo), bool)
            weight[todo[hit]] += self.arc_weight[arc[hit]]
            after[todo[hit]] = self.arc_next[arc[hit]]
            root = at == 0
            weight[todo[root]] += self.root_weight[here[root]]
            after[todo[root]] = self.root_next[here[root]]
            fails = ~hit & ~root
            todo, at = todo[fails], at[fails]
            weight[todo] += self.fail_weight[at]
            now[todo] = self.fail_next[at]
        return after, weight

    def scores(self, grams: BlockNgrams) -> np.ndarray:
        """The weight of each text's path."""
        words = grams.where[0]
        lanes = -(-grams.lengths // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = grams.begin[text] + 1 + number * LANE
        length = np.minimum(LANE, grams.lengths[text] - number * LANE)
        state = np.full(len(text), self.start)
        inside = np.flatnonzero(number > 0)  # these read the two words before them, from the root, for their state
        state[inside] = 0
        for back in (2, 1):
            state[inside] = self.read(state[inside], words[first[inside] - back])[0]
        order = np.argsort(-length, kind="stable")
        first, length, text, state = first[order], length[order], text[order], state[order]
        weight = np.zeros(len(text))
        for step in range(int(length.max(initial=0))):
            alive = int(np.searchsorted(-length, -step, side="left"))  # lanes of over `step` tokens
            state[:alive], w = self.read(state[:alive], words[first[:alive] + step])
            weight[:alive] += w
        return np.bincount(text, weight, minlength=len(lanes))


def _planes(values: np.ndarray) -> bytes:
    """An array with its bytes regrouped by significance and compressed: high bytes of small numbers cost next to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unplanes(data: bytes, n: int, dtype: str) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _messages(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending keys and their counts (twice the count, and 1 if several blocks have the key), cut by the keys' highest bits into rows of ASK_SCHEMA."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
    counts = counts.astype("<u8")
    parts = np.flatnonzero(np.diff(cuts)).tolist()
    lines = [{"block": block, "part": p, "n": int(b - a), "keys": _planes(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": _planes(counts[a:b])} for p in parts for a, b in [(cuts[p], cuts[p + 1])]]
    return pa.RecordBatch.from_pylist(lines, schema=_arrow(ASK_SCHEMA))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _summed(asking: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some messages, each message's keys' places among them, and summed counts (coded as in _messages)."""
    keys = [np.cumsum(_unplanes(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in asking]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    coded = np.concatenate([_unplanes(r["counts"], r["n"], "<u8") for r in asking])
    several = np.bincount(place, 1 + (coded & np.uint64(1)), len(every)) > 1
    return every, place, np.bincount(place, coded >> np.uint64(1), len(every)).astype("<u8") * np.uint64(2) + several


def _reply(asking: list[dict], values: np.ndarray) -> list[dict]:
    """Each message's share of values, which lie in the order of the messages."""
    lines, at = [], 0
    for r in asking:
        lines.append({"block": r["block"], "part": r["part"], "n": r["n"], "totals": _planes(np.ascontiguousarray(values[at : at + r["n"]]))})
        at += r["n"]
    return lines


def exchange(questions: Callable[[int], DataFrame], shards_bits: int, blocks: int, scratch: Scratch, label: str) -> DataFrame:
    """The corpus-wide totals (ANSWER_SCHEMA, written; coded as in _messages) of what blocks ask for; rows of block -1 count types and tokens of a shard.

    questions(bits) has the messages (ASK_SCHEMA), cut by so many bits. With over DIRECT_SHARDS shards a message for each
    pair of block and shard would hold next to nothing, so the shards' groups (about the root of their number) are
    addressed first: a relay takes the messages of some blocks to one group, adds them up, passes them on and hands the answers back."""

    def answer(table: pa.Table) -> pa.Table:
        asking = table.to_pylist()
        every, place, counts = _summed(asking)
        single = (every & np.uint64(1)) == 0
        once = counts >> np.uint64(1)
        lines = [{"block": -1, "part": asking[0]["part"], "n": int((single & (once > 0)).sum()), "tokens": int(once[single].sum())}]
        return pa.Table.from_pylist(lines + _reply(asking, counts[place]), schema=_arrow(ANSWER_SCHEMA))

    if 1 << shards_bits <= DIRECT_SHARDS:
        return scratch.keep(questions(shards_bits).groupBy("part").applyInArrow(answer, ANSWER_SCHEMA), label, "none")

    near = (shards_bits + 1) // 2
    sets = max(1, blocks >> near)  # a relay holds about as much as a shard does
    relayed = F.pmod(F.xxhash64("block"), F.lit(sets)).cast("int")
    asked = scratch.keep(questions(near), f"{label}-asked", "none").withColumn("relay", F.col("part").cast("long") * sets + relayed)

    def merge(table: pa.Table) -> pa.Table:
        every, _, counts = _summed(table.to_pylist())
        return pa.Table.from_batches([_messages(table.column("relay")[0].as_py(), every, counts, shards_bits)])

    relays = asked.groupBy("relay").applyInArrow(merge, ASK_SCHEMA)
    totals = scratch.keep(relays.groupBy("part").applyInArrow(answer, ANSWER_SCHEMA), f"{label}-relays", "none")

    def back(asking: pa.Table, answers: pa.Table) -> pa.Table:
        if not asking.num_rows:
            return _arrow(ANSWER_SCHEMA).empty_table()
        lines = asking.to_pylist()
        found = np.concatenate([_unplanes(r["totals"], r["n"], "<u8") for r in sorted(answers.to_pylist(), key=lambda r: r["part"])])
        return pa.Table.from_pylist(_reply(lines, found[_summed(lines)[1]]), schema=_arrow(ANSWER_SCHEMA))

    handed = asked.groupBy("relay").cogroup(totals.filter("block >= 0").withColumnRenamed("block", "relay").groupBy("relay")).applyInArrow(back, ANSWER_SCHEMA)
    return scratch.keep(handed.unionByName(totals.filter("block = -1")), label, "none")


def _texts(r: dict) -> list[bytes]:
    import zstandard

    joined, texts, at = zstandard.ZstdDecompressor().decompress(r["texts"], max_output_size=sum(r["lengths"]) or 1), [], 0
    for length in r["lengths"]:
        texts.append(joined[at : at + length])
        at += length
    return texts


def _totals(answers: list[dict], n: int) -> np.ndarray:
    parts = [_unplanes(t["totals"], t["n"], "<u8") for t in sorted(answers, key=lambda t: t["part"])]
    return np.concatenate(parts) if n else np.zeros(0, np.uint64)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of each row; rows with `training` teach the model.

    Words are stretches without ASCII white space, A-Z in lower case; every text ends with one end token. Null or empty
    text: the end token alone. Null or repeated doc_id: a row each. No training rows: every probability is the
    unknown word's. Empty table: no rows. A text of any length lies whole in one block. Ties: equal texts have equal scores.
    Other columns, whatever their names, are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    schema = "block long, bytes long, ids array<long>, training array<boolean>, lengths array<int>, texts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, teach, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = {"block": block, "bytes": held, "ids": ids, "training": teach, "lengths": [len(t) for t in texts], "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], schema=_arrow(schema))

        for part in row_slices(batches):
            for doc_id, text, is_training in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(doc_id)
                texts.append(text.encode())
                teach.append(is_training)
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield close()
                    ids, texts, teach, held, block = [], [], [], 0, block + 1
        if ids:
            yield close()

    blocks = scratch.keep(rows.mapInArrow(cut, schema), "blocks", "none")
    size, n_blocks = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits = max(LEAST_SHARDS - 1, int(size / 7 / SHARD_NGRAMS)).bit_length()

    def ask_low(shards: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in row_slices(batches, 1):
                (r,) = part.to_pylist()
                grams, teaches = BlockNgrams(_texts(r), 2), np.array(r["training"], bool)
                keys, order = grams.low_orders()
                yield _messages(r["block"], keys, 2 * np.concatenate([grams.training_counts(teaches, k) for k in (0, 1)])[order], shards)

        return blocks.mapInArrow(ask, ASK_SCHEMA)

    low = exchange(ask_low, bits, n_blocks, scratch, "low")
    total, types = low.filter("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_block = blocks.groupBy("block")
    low_answers = low.filter("block >= 0").select("block", "part", "n", "totals", F.lit(0).alias("level"))

    def ask_triples(shards: int) -> DataFrame:
        def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
            if not block.num_rows:
                return _arrow(ASK_SCHEMA).empty_table()
            (r,) = block.to_pylist()
            grams, teaches = BlockNgrams(_texts(r)), np.array(r["training"], bool)
            pair = grams.spread_low(_totals(answers.to_pylist(), len(grams.keys[0])))[1]
            wanted = grams.open_triples((pair & np.uint64(1)) > 0)
            return pa.Table.from_batches([_messages(r["block"], grams.keys[2][wanted], 2 * grams.training_counts(teaches, 2)[wanted], shards)])

        return by_block.cogroup(low_answers.groupBy("block")).applyInArrow(ask, ASK_SCHEMA)

    high = exchange(ask_triples, bits, n_blocks, scratch, "triples")
    answered = low_answers.unionByName(high.filter("block >= 0").select("block", "part", "n", "totals", F.lit(1).alias("level")))
    out_schema = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"

    def traverse(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _arrow(out_schema).empty_table()
        (r,) = block.to_pylist()
        grams, teaches = BlockNgrams(_texts(r)), np.array(r["training"], bool)
        lines = answers.to_pylist()
        single, pair = grams.spread_low(_totals([a for a in lines if a["level"] == 0], len(grams.keys[0])))
        wanted = grams.open_triples((pair & np.uint64(1)) > 0)
        single, pair = single >> np.uint64(1), pair >> np.uint64(1)
        triple = grams.training_counts(teaches, 2).astype(np.uint64)
        triple[wanted] = _totals([a for a in lines if a["level"] == 1], int(wanted.sum())) >> np.uint64(1)
        automaton = Automaton(grams, [single, pair, triple], total, types)
        starts = grams.begin - np.arange(len(grams.begin))
        words = grams.where[0][grams.where[0] >= 0]
        known, base = np.add.reduceat(single[words] > 0, starts, dtype=np.int64), np.add.reduceat(automaton.root_weight[words], starts)
        columns = [r["ids"], r["training"], grams.lengths, known, base, automaton.scores(grams)]
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(columns, _arrow(out_schema).types, strict=True)], schema=_arrow(out_schema))

    scored = by_block.cogroup(answered.groupBy("block")).applyInArrow(traverse, out_schema)
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, id_remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
