"""Collocations by compressed position bitmaps.

Texts of one language are cut into blocks of some megabytes. The tokens of a block lie in a row, with an empty place between pieces, and
each word that is frequent in the whole corpus has a bitmap of its places, of which only the machine words that aren't zero are kept.
A phrase is extended by shifting its bitmap one place and taking AND with the bitmaps of words; as the places between pieces and those of
rare words are in no bitmap, no phrase reaches over them. Popcounts are summed over blocks. Phrases grow depth-first, some
first words at a time, so that the bitmaps of few phrases exist at once; a pair is extended if it is frequent in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.common import Scratch, offsets, part_of, row_of, row_slices, shuffle_parts
from scorewright.llm.lm_scoring import ASK_SCHEMA, LEAST_SHARDS, _messages, _mix, _planes, _totals, _unplanes, exchange

#: UTF-8 bytes of text after which a block is closed; all blocks of a task are closed when they hold HELD_BLOCKS times as much.
BLOCK_BYTES = 6 << 20
HELD_BLOCKS = 3
#: Pairs that a shard of the pair space should hold.
SHARD_PAIRS = 1_500_000
#: Places in a machine word of a bitmap, and candidates for AND that are tried at once.
BITS = 32
CANDIDATES = 1 << 21
#: A-Z in lower case; what ends a piece becomes a byte that no UTF-8 text has.
GAP = b"\xff"
FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Numbers(dict):
    """Words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Distinct words of texts, and the tokens in a row: 0 between pieces, else 1 + the word's number."""
    numbers = _Numbers({GAP: 0})
    found = GAP.join(t.translate(FOLD) for t in texts).replace(GAP, b" \xff ").split()
    row = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
    return [w.decode() for w in list(numbers)[1:]], row


class Bitmaps:
    """Compressed bitmaps of the places of the words 0 .. words - 1 in a row of tokens (1 + word, 0: none)."""

    def __init__(self, row: np.ndarray, words: int) -> None:
        places = np.flatnonzero(row)
        self.words, self.chunks = words, len(row) // BITS + 1
        key = (row[places].astype(np.int64) - 1) * self.chunks + places // BITS
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        bits = np.uint32(1) << (places % BITS).astype(np.uint32)
        self.mask = np.bitwise_or.reduceat(bits, first) if len(first) else np.zeros(0, np.uint32)
        self.word, self.chunk = np.divmod(key[first], self.chunks)
        order = np.argsort(self.chunk, kind="stable")
        self.word_in, self.mask_in = self.word[order], self.mask[order]
        self.begin = np.searchsorted(self.chunk[order], np.arange(self.chunks + 1))

    def extend(self, chunk: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps shifted by one place, AND each word's: which entry, the word, the chunk and the mask of what isn't zero."""
        over = np.flatnonzero((mask >> np.uint32(BITS - 1)) & (chunk + 1 < self.chunks))
        entry = np.concatenate([np.arange(len(chunk)), over])
        chunk = np.concatenate([chunk, chunk[over] + 1])
        mask = np.concatenate([mask << np.uint32(1), np.ones(len(over), np.uint32)])
        count = self.begin[chunk + 1] - self.begin[chunk]
        tried = np.repeat(np.arange(len(chunk)), count)
        other = np.arange(len(tried)) + np.repeat(self.begin[chunk] - np.cumsum(count) + count, count)
        both = mask[tried] & self.mask_in[other]
        hit = np.flatnonzero(both)
        tried = tried[hit]
        return entry[tried], self.word_in[other[hit]], chunk[tried], both[hit]

    def pairs_by_run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys (first * words + second), chunks and masks of the pairs' bitmaps, some first words after the other."""
        cost = np.cumsum(self.begin[self.chunk + 1] - self.begin[self.chunk] + 1)
        cuts = np.searchsorted(cost, np.arange(0, cost[-1] + CANDIDATES, CANDIDATES)) if len(cost) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            entry, second, chunk, mask = self.extend(self.chunk[lo:hi], self.mask[lo:hi])
            yield self.word[lo:hi][entry] * self.words + second, chunk, mask

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs, ascending, and their numbers of occurrences."""
        return _summed([(key, np.bitwise_count(mask)) for key, _, mask in self.pairs_by_run()])

    def triples(self, keys: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (place of the first pair among keys * words + third) and occurrences of the triples whose both pairs are frequent."""
        found = []
        for key, chunk, mask in self.pairs_by_run():
            pair = np.searchsorted(keys, key)
            grows = np.flatnonzero(frequent[pair])
            entry, third, _, mask = self.extend(chunk[grows], mask[grows])
            pair = pair[grows[entry]]
            fits = np.flatnonzero(frequent[np.searchsorted(keys, keys[pair] % self.words * self.words + third)])
            found.append((pair[fits] * self.words + third[fits], np.bitwise_count(mask[fits])))
        return _summed(found)


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not counted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counted = [(keys, np.bincount(place, count, len(keys))) for key, count in counted for keys, place in [np.unique(key, return_inverse=True)]]
    keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in counted]), len(keys)).astype(np.int64)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of texts of one language: distinct words, their counts, and the tokens as places among the words."""
    schema = "block long, lang string, size long, n_words long, words array<string>, counts array<int>, row binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, row = tokens(held.pop(lang))
            del sizes[lang]
            counts = np.bincount(row, minlength=len(words) + 1)[1:]
            line = [[number], [lang], [len(row)], [int(counts.sum())], [words], [counts.astype(np.int32)], [_planes(row)]]
            number += 1
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(line, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for part in row_slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = text.encode()
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                if sizes[lang] >= BLOCK_BYTES:
                    yield close(lang)
                elif sum(sizes.values()) >= HELD_BLOCKS * BLOCK_BYTES:
                    for other in list(held):
                        yield close(other)
        for lang in list(held):
            yield close(lang)

    return rows.mapInArrow(cut, schema)


def _number(blocks: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """The words that occur `least` times in a language, with ids from 0 over all languages."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    often = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    often = scratch.keep(often.withColumn("mid", F.monotonically_increasing_id()), "often").withColumn("part", part_of("mid"))
    starts = offsets(often.groupBy("part").agg(F.count("*").alias("n")), "part", "n", "start")
    return often.join(F.broadcast(starts), "part").select("lang", "word", "f", (F.col("start") + row_of("mid")).alias("id"))  # one row for each partition


def _coded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with the ids of their frequent words, ascending, and tokens as 1 + place among these (0: between pieces, or a rare word)."""
    schema = "block long, size long, ids binary, row binary"
    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("asker"), "place", "id")

    def code(block: pa.Table, known: pa.Table) -> pa.Table:
        size = block.column("size")[0].as_py()
        ids, place = known.column("id").to_numpy(), known.column("place").to_numpy()
        order = np.argsort(ids)
        new = np.zeros(len(block.column("words")[0]) + 1, np.uint32)
        new[place[order] + 1] = np.arange(1, len(ids) + 1)
        row = new[_unplanes(block.column("row")[0].as_py(), size, "<u4")]
        return pa.table({"block": block.column("block"), "size": block.column("size"), "ids": [ids[order].astype("<u4").tobytes()], "row": [_planes(row)]})

    return blocks.select("block", "size", "words", "row").groupBy("block").cogroup(known.groupBy("asker")).applyInArrow(code, schema)


def _read(line: dict) -> tuple[np.ndarray, Bitmaps]:
    ids = np.frombuffer(line["ids"], "<u4").astype(np.int64)
    return ids, Bitmaps(_unplanes(line["row"], line["size"], "<u4"), len(ids))


def _pair_keys(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Pairs as numbers spread over 64 bits, one to one as long as there are under 2^32 frequent words."""
    first, second = np.divmod(keys, max(1, len(ids)))
    return _mix(ids[first].astype(np.uint64) << np.uint64(32) | ids[second].astype(np.uint64))


def counted_phrases(docs: DataFrame, lang: Column, least: int, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), pairs (first, second, f), triples (first, second, third, f), and words of each language (lang, n)."""
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = scratch.keep(_blocks(rows), "blocks")
    words = scratch.keep(_number(blocks, least, scratch), "words")
    if words.count() >> 32:
        raise ValueError("over 2^32 frequent words")
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    coded = scratch.keep(_coded(blocks, words), "coded", "none")
    size, n_blocks = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    bits = max(LEAST_SHARDS - 1, int(size / SHARD_PAIRS)).bit_length()

    def ask(shards: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in row_slices(batches, 1):
                (line,) = part.to_pylist()
                ids, bitmaps = _read(line)
                keys, counts = bitmaps.pairs()
                mixed = _pair_keys(ids, keys)
                order = np.argsort(mixed)
                yield _messages(line["block"], mixed[order], 2 * counts[order], shards)

        return coded.mapInArrow(run, ASK_SCHEMA)

    answers = exchange(ask, bits, n_blocks, scratch, "pairs").filter("block >= 0").select("block", "part", "n", "totals")
    schema = "first long, second long, third long, f long"

    def grow(block: pa.Table, answers: pa.Table) -> pa.Table:
        (line,) = block.to_pylist()
        ids, bitmaps = _read(line)
        keys, _ = bitmaps.pairs()
        total = np.zeros(len(keys), np.int64)
        total[np.argsort(_pair_keys(ids, keys))] = _totals(answers.to_pylist(), len(keys)).astype(np.int64) >> 1
        frequent = np.flatnonzero(total >= least)
        first, second = np.divmod(keys, max(1, len(ids)))
        triples, counts = bitmaps.triples(keys, total >= least) if len(frequent) else _summed([])
        pair, third = np.divmod(triples, max(1, len(ids)))
        columns = [ids[np.concatenate([first[frequent], first[pair]])], ids[np.concatenate([second[frequent], second[pair]])]]
        columns += [np.concatenate([np.full(len(frequent), -1), ids[third]]), np.concatenate([total[frequent], counts])]
        return pa.table(dict(zip(("first", "second", "third", "f"), columns, strict=True)))

    grown = scratch.keep(coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(grow, schema), "grown")
    pairs = grown.filter("third < 0").groupBy("first", "second").agg(F.max("f").alias("f"))
    triples = grown.filter("third >= 0").groupBy("first", "second", "third").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return words, scratch.keep(pairs, "frequent-pairs"), scratch.keep(triples, "frequent-triples"), totals


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10^15."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0))) DIV (CAST({left} AS DECIMAL(38,0)) * CAST({right} AS DECIMAL(38,0)))").cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, best: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of two and three words that occur `least` times in a language.

    Words are stretches without blanks inside pieces, A-Z in lower case; pieces end at `.,;:!?` and line ends. A phrase is scored at the cut
    that scores lowest, of equal ones the first. It is left out if it lies inside a longer one that occurs at least `inside` percent as often.
    The first `best` of each language are returned, all if None; ties in score go to the more frequent, then to the first phrase in byte order.

    Null text: no words. Null lang: `und`. Ids are not read, so null and repeated rows count like others. Long texts are read whole, in one
    block. Empty table: no rows. Other columns, whatever their names, are ignored."""
    scratch = Scratch(docs.sparkSession, "phrases")
    words, pairs, triples, totals = counted_phrases(docs, F.col(lang_col), least, text_col, scratch)

    def word(place: str) -> DataFrame:
        return words.select(F.col("id").alias(place), F.col("word").alias(f"{place}_word"), F.col("f").alias(f"{place}_f"), F.col("lang").alias(f"{place}_lang"))

    longer = triples.select("first", "second", "f").unionByName(triples.select(F.col("second").alias("first"), F.col("third").alias("second"), "f"))
    longer = longer.groupBy("first", "second").agg(F.max("f").alias("longest"))
    twos = pairs.join(longer, ["first", "second"], "left").filter(F.coalesce(100 * F.col("longest") < inside * F.col("f"), F.lit(True)))
    twos = twos.join(word("first"), "first").join(word("second"), "second").select(
        F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_word", "second_word").alias("phrase"), F.col("f").alias("a"),
        F.col("first_f").alias("l"), F.col("second_f").alias("r"), _score("f", "first_f", "second_f").alias("score"),
    )
    heads = pairs.withColumnRenamed("f", "head_f")
    tails = pairs.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("f").alias("tail_f"))
    threes = triples.join(heads, ["first", "second"]).join(tails, ["second", "third"]).join(word("first"), "first").join(word("second"), "second").join(word("third"), "third")
    threes = threes.withColumns({"early": _score("f", "first_f", "tail_f"), "late": _score("f", "head_f", "third_f")})
    second_cut = F.col("late") < F.col("early")
    threes = threes.select(
        F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_word", "second_word", "third_word").alias("phrase"), F.col("f").alias("a"),
        F.when(second_cut, F.col("head_f")).otherwise(F.col("first_f")).alias("l"), F.when(second_cut, F.col("third_f")).otherwise(F.col("tail_f")).alias("r"),
        F.least("early", "late").alias("score"),
    )
    found = twos.unionByName(threes)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranges = found.repartitionByRange(shuffle_parts(docs.sparkSession), "lang", *order).withColumn("part", F.spark_partition_id())
    ranges = scratch.keep(ranges, "ranges")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a language
    starts = ranges.groupBy("lang", "part").agg(F.count("*").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    if best is not None:
        starts = starts.filter(F.col("start") < best)
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ranked = ranges.join(starts.select("lang", "part", "start"), ["lang", "part"]).withColumn("rank", F.col("start") + place)
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS part FROM (SELECT doc, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
listed AS (SELECT doc, lang, part, string_split_regex(trim(piece, chr(32) || chr(9)), '[\x20\x09]+') AS w FROM pieces WHERE trim(piece, chr(32) || chr(9)) <> ''),
each AS (SELECT doc, lang, part, unnest(w) AS w1, generate_subscripts(w, 1) AS place FROM listed),
follow AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM each WINDOW o AS (PARTITION BY doc, part ORDER BY place)),
n AS (SELECT lang, count(*) AS n FROM each GROUP BY lang),
one AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM follow GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM follow WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM follow WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 WHERE t.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * t.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
