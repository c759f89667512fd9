"""Packing by cutting-stock column generation.

Whole sequences are cut off long documents; what remains of each document is an item of 1 to capacity - 1 tokens. Only
the histogram of item lengths (fewer than `capacity` numbers, whatever the data) reaches the driver. There a linear
program over patterns of lengths is solved by column generation: a dense revised simplex gives prices, a knapsack
dynamic program finds the pattern of best price, until no pattern can improve the bound by more than `gap`. Patterns
are used as often as their rounded-down values say; items left over are packed best-fit, by length and number; items of
sequences that would stay emptier than `slack` are laid end to end and cut. Items are ranked within their length in parallel, and a small
layout table turns length and rank into sequence and offset.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.common import Scratch, part_of, row_slices
from scorewright.llm.tokens import encoder, read_definition

#: Default of pack()'s `slack`: the share of a sequence that may stay empty before its items are laid end to end and cut.
SLACK = 0.005
#: Pieces that are cut again are joined by broadcasting their places up to this many of them, and by a shuffle beyond.
BROADCAST_CUTS = 200_000
LAYOUT_SCHEMA = "length int, rank_from long, rank_to long, each int, sequence_from long, offset_from int, stream long"


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The most valuable multiset of lengths that fits, by dynamic programming over capacities."""
    order = np.argsort(lengths)
    lengths, prices = lengths[order], prices[order]
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room], choice[room] = value[room - 1], -1
        if k := usable[room]:
            worth = value[room - lengths[:k]] + prices[:k]
            best = int(worth.argmax())
            if worth[best] > value[room]:
                value[room], choice[room] = worth[best], best
    found, room = Counter(), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        found[int(order[choice[room]])] += 1
        room -= int(lengths[choice[room]])
    return float(value[capacity]), found


def first_columns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Counter], np.ndarray]:
    """A basis and its values: the longest length with demand left, filled up by the knapsack over such lengths at the
    prices length / capacity, is used until one of its lengths runs out. Each column ends one length, so they are independent."""
    left, patterns, amounts = demand.astype(np.float64).copy(), [None] * len(lengths), np.zeros(len(lengths))
    alive = np.ones(len(lengths), bool)
    while alive.any():
        longest = int(np.flatnonzero(alive)[-1])
        room = capacity - int(lengths[longest])
        usable = np.flatnonzero(alive & (lengths <= room))
        found = Counter({longest: 1})
        if len(usable):
            exact = usable[lengths[usable] == room]
            filler = Counter({0: 1}) if len(exact) else best_pattern(lengths[usable], lengths[usable] / capacity, room)[1]
            usable = exact if len(exact) else usable
            for i, copies in filler.items():
                found[int(usable[i])] += copies
        amount, ends = min((left[i] / copies, i) for i, copies in found.items())
        for i, copies in found.items():
            left[i] = max(0.0, left[i] - amount * copies)
        patterns[ends], amounts[ends], alive[ends] = found, amount, False
    return patterns, amounts


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 500) -> list[tuple[Counter, float]]:
    """Patterns (item number -> copies) and their values, by column generation for the linear program: least total
    value whose copies meet the demand of each length (ascending).

    It ends when the value is within `gap` of a lower bound (the tokens over the capacity, or the prices' value over
    the best pattern's worth), or after `rounds` pivots; any basis on the way meets the demand."""
    m = len(lengths)
    patterns, amounts = first_columns(lengths, demand, capacity)
    matrix = np.zeros((m, m))
    for k, found in enumerate(patterns):
        for i, copies in found.items():
            matrix[i, k] = copies
    inverse = np.linalg.inv(matrix)
    bound = float(lengths @ demand) / capacity  # length / capacity are feasible prices
    centre = lengths / capacity
    for _ in range(rounds):
        if amounts.sum() <= bound * (1 + gap):
            break
        prices = inverse.sum(axis=0)
        smooth = 0.5 * prices + 0.5 * centre  # steadier than the basis prices, which jump
        worth, found = best_pattern(lengths, smooth, capacity)
        bound = max(bound, float(smooth @ demand) / worth)
        if sum(prices[i] * c for i, c in found.items()) <= 1 + 1e-9:
            worth, found = best_pattern(lengths, prices, capacity)
            bound = max(bound, float(prices @ demand) / worth)
            if worth <= 1 + 1e-9:
                break
        column = np.zeros(m)
        for i, copies in found.items():
            column[i] = copies
        way = inverse @ column
        ratio = np.where(way > 1e-9, amounts / np.maximum(way, 1e-9), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amounts = np.maximum(amounts - step * way, 0)
        amounts[out] = step
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        patterns[out] = found
    return list(zip(patterns, amounts.tolist(), strict=True))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Lengths, longest first, each into the fullest sequence that has room for it: contents and how many sequences have them.

    Sequences with equal contents are handled together, and each length adds two kinds at most, so the cost depends on the capacity only."""
    by_room: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]

    def put(contents: Counter, length: int, copies: int, sequences: int, room: int) -> None:
        if sequences:
            by_room[room - copies * length].append((contents + Counter({length: copies}), sequences))

    for length, left in sorted(histogram.items(), reverse=True):
        while left > 0:
            room = next((r for r in range(length, capacity) if by_room[r]), capacity)
            contents, sequences = by_room[room].pop() if room < capacity else (Counter(), -(-left // (capacity // length)))
            copies = room // length  # a sequence that has taken one stays the fullest until it has no room for another
            full = min(sequences, left // copies)
            put(contents, length, copies, full, room)
            left -= full * copies
            if full < sequences:
                put(contents, length, left, int(left > 0), room)
                if rest := sequences - full - int(left > 0):
                    by_room[room].append((contents, rest))
                left = 0
    return [found for kinds in by_room for found in kinds]


def layout(histogram: dict[int, int], capacity: int, gap: float = 0.002, slack: float = SLACK) -> list[tuple]:
    """Rows of LAYOUT_SCHEMA: where the items of a length and a range of ranks lie.

    Rows with a null stream are patterns: `each` copies of the length lie side by side in every sequence. Rows with a
    stream position lie end to end from there, cut where a sequence ends: patterns that fill too little (a length that
    a third of all documents share may fit nothing) and loose leftovers. The number of rows depends on the capacity only."""
    rows, rank, sequence = [], Counter(), 0
    if whole := histogram.get(capacity, 0):
        rows.append((capacity, 0, whole, 1, 0, 0, None))
        sequence = whole

    def lay(pattern: Counter, uses: int) -> None:
        nonlocal sequence
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, rank[length], rank[length] + copies * uses, copies, sequence, offset, None))
            rank[length] += copies * uses
            left[length] -= copies * uses
            offset += copies * length
        sequence += uses

    lengths = np.array(sorted(x for x in histogram if 0 < x < capacity), np.int64)
    left = {int(x): histogram[int(x)] for x in lengths}
    if len(lengths):
        demand = np.array([histogram[int(x)] for x in lengths], np.float64)
        for pattern, amount in column_generation(lengths, demand, capacity, gap):
            named = Counter({int(lengths[i]): c for i, c in pattern.items()})
            uses = min([int(amount + 1e-6), *(left[x] // c for x, c in named.items())])
            if uses > 0 and sum(x * c for x, c in named.items()) >= (1 - slack) * capacity:
                lay(named, uses)
        for packed, uses in best_fit(left, capacity):
            if sum(x * c for x, c in packed.items()) >= (1 - slack) * capacity:
                lay(packed, uses)
        stream = 0
        for length, n in left.items():
            if n:
                rows.append((length, rank[length], rank[length] + n, 1, sequence, 0, stream))
                stream += length * n
    return rows


@dataclass
class Packed:
    """pieces: mid, doc_id, doc_tokens, piece_start, piece_length, ids (little-endian uint32), as tokenised.
    placed: mid, cut_from, cut_length, sequence_id, offset, narrow; pieces laid end to end may have two rows.
    cuts: an upper bound of the pieces that are cut again."""

    pieces: DataFrame
    placed: DataFrame
    cuts: int

    def slices(self) -> DataFrame:
        """Every final piece with its ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

        A piece that isn't cut again keeps its row beside the scan; only ids of length columns are joined. Null and repeated doc_ids are documents
        of their own; without documents there are no rows."""
        joined = self.pieces.join(self.placed, "mid")
        ids = F.expr("substring(ids, int(cut_from * 4 + 1), int(cut_length * 4))")
        return joined.select("doc_id", (F.col("piece_start") + F.col("cut_from")).alias("start"), F.col("cut_length").alias("length"), ids.alias("ids"), "doc_tokens", "sequence_id", "offset")

    def sequences(self) -> DataFrame:
        """sequence_id and ids (binary) of each packed sequence, not padded; without documents no rows."""
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` parts
        joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
        return self.slices().groupBy("sequence_id").agg(joined.alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, gap: float = 0.002, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """Pack all documents into sequences of at most `capacity` tokens.

    `gap` is how near to its bound the linear program is solved, `slack` the share of a sequence that may stay empty: items of
    looser ones are laid end to end and cut, as the contract lets ids be cut freely. Both hold alike at every size; slack 1 cuts nothing.
    Null text: the end id alone. Null or repeated doc_id: each row is a document of its own. Empty table: no pieces.
    A document of any length: whole sequences and a remainder. Ties: items of a length are ranked in the order they
    were written, which any re-run of a lost task repeats, as it reads the written table.
    Other columns, whatever their names, are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    definition = read_definition(spark, tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(definition.value)
        for rows in row_slices(batches):
            doc_ids, starts, lengths, totals, ids = [], [], [], [], []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                coded = tool.encode(text or "") + end
                total = len(coded) // 4
                for start in range(0, total, capacity):
                    piece = coded[4 * start : 4 * (start + capacity)]
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    totals.append(total)
                    ids.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "doc_tokens", "piece_start", "piece_length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(cut, "doc_id long, doc_tokens long, piece_start long, piece_length int, ids binary")
    pieces = scratch.keep(pieces.withColumn("mid", F.monotonically_increasing_id()), "pieces")

    items = pieces.select("mid", F.col("piece_length").alias("length"), part_of("mid").alias("part"))
    counts = scratch.keep(items.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    rows_of_layout = layout(histogram, capacity, gap, slack)
    where = spark.createDataFrame(rows_of_layout, LAYOUT_SCHEMA)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("mid")) - 1
    ranked = items.withColumn("number", number).join(counts.withColumn("before", before).drop("n"), ["length", "part"])
    ranked = ranked.select("mid", "length", (F.col("before") + F.col("number")).alias("rank"))
    # the layout's size is bounded by the capacity alone
    placed = ranked.join(F.broadcast(where), "length").filter("rank >= rank_from AND rank < rank_to")
    at = "(stream + (rank - rank_from) * length)"
    head = f"least(length, {capacity} - {at} % {capacity})"
    whole = F.expr("array(named_struct('cut_from', 0L, 'cut_length', bigint(length), 'sequence_id', sequence_from + (rank - rank_from) div each, 'offset', bigint(offset_from + ((rank - rank_from) % each) * length)))")
    laid = F.expr(f"""array(named_struct('cut_from', 0L, 'cut_length', bigint({head}), 'sequence_id', sequence_from + {at} div {capacity}, 'offset', bigint({at} % {capacity})),
        named_struct('cut_from', bigint({head}), 'cut_length', bigint(length - {head}), 'sequence_id', sequence_from + {at} div {capacity} + 1, 'offset', 0L))""")
    placed = placed.select("mid", "length", F.inline(F.when(F.col("stream").isNull(), whole).otherwise(laid))).filter("cut_length > 0")
    cuts = sum((r[2] - r[1]) * r[0] for r in rows_of_layout if r[6] is not None) // capacity
    return Packed(pieces, scratch.keep(placed, "placed"), cuts)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 0))


def digest(packed: Packed) -> DataFrame:
    """The packed pieces with a checksum of their ids instead of the ids.

    Checksums are taken beside the scan, so no ids are shuffled for pieces that stay whole. The places of the pieces that
    were cut again are broadcast if they are few, as the layout knows; else they are joined by a shuffle. Rows as in slices()."""
    whole, again = (packed.placed.filter(x) for x in ("cut_length = length", "cut_length < length"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = packed.pieces.select("mid", "doc_id", "doc_tokens", "piece_start", F.crc32("ids").alias("ids_crc32"))
    out = sums.join(whole, "mid").withColumn("start", F.col("piece_start")).withColumn("length", F.col("length").cast("long")).select(columns)
    cut = packed.pieces.join(F.broadcast(again) if packed.cuts <= BROADCAST_CUTS else again, "mid")
    cut = cut.withColumn("ids_crc32", F.crc32(F.expr("substring(ids, int(cut_from * 4 + 1), int(cut_length * 4))"))).withColumn("start", F.col("piece_start") + F.col("cut_from"))
    return out.unionByName(cut.withColumn("length", F.col("cut_length")).select(columns))
