"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Distinct pieces of about the same byte length become the rows of a matrix of ids. In each round every row looks all its
neighbouring pairs up in a hash table, merges its leftmost pair of minimum rank and closes the gap; rows without a
mergeable pair leave. A wide row lies in segments that keep their least rank and close their gaps on their own, so a round costs
about the root of the row's length, and one way serves pieces of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import PieceCache, only, row_slices
from scorewright.shipping import ship

NONE = np.int32((1 << 31) - 1)
#: Cells of one matrix; more rows are done in turns.
CELLS = 1 << 20
#: Cells of a segment at least; longer rows have segments of about the root of their length.
SEGMENT = 64
#: Whose memos the encoders' are, see common.only.
OWNER = "byte_bpe"


class PairTable:
    """(left id, right id) -> merged id, by open addressing with linear probing; lookups take whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(merged) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has none (a negative id is padding)."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class ByteBpe:
    """Encoder and decoder of one rank file. A rank is an id; the lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.word = {i: w for w, i in ranks.items()}
        pairs = [(ranks[w[:k]], ranks[w[k:]], i) for w, i in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.table = PairTable(left, right, merged)
        self.memo = PieceCache(lambda stretch: self.encode([stretch])[0], OWNER)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (not empty)."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.array([whole])
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4 if len(piece) <= 32 else 1 << (len(piece) - 1).bit_length(), []).append(k)
        for width, members in buckets.items():
            turn = max(1, CELLS // width)
            for at in range(0, len(members), turn):
                mine = members[at : at + turn]
                for k, ids in zip(mine, self._merge_matrix([pieces[k] for k in mine], width), strict=True):
                    out[k] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Rows of segments of cells: grid has the ids (-1 behind the last of a segment), ranks what each id makes with the next one of its row."""
        cell = min(width, max(SEGMENT, 1 << (width.bit_length() + 1) // 2))
        parts = width // cell
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        grid = np.where(np.arange(width) < lengths[:, None], self.single[data], np.int32(-1))
        ranks = np.full(grid.shape, NONE, np.int32)
        ranks[:, :-1] = self.table.find(grid[:, :-1], grid[:, 1:])
        grid, ranks = grid.reshape(-1, parts, cell), ranks.reshape(-1, parts, cell)
        used = np.clip(lengths[:, None] - np.arange(parts) * cell, 0, cell)
        following = np.where(np.arange(1, parts + 1) * cell < lengths[:, None], np.arange(1, parts + 1), -1)
        preceding = np.broadcast_to(np.arange(-1, parts - 1), used.shape).copy()
        least, rows, out = ranks.min(axis=2), np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            part = least.argmin(axis=1)
            every = np.arange(len(rows))
            lowest = least[every, part]
            stays = lowest != NONE
            if not stays.all():
                for k, ids in zip(rows[~stays].tolist(), grid[~stays], strict=True):
                    out[k] = ids[ids >= 0]
                rows, grid, ranks, used, following, preceding, least, part, lowest = (x[stays] for x in (rows, grid, ranks, used, following, preceding, least, part, lowest))
                if not len(rows):
                    break
                every = np.arange(len(rows))
            at = ranks[every, part].argmin(axis=1)
            grid[every, part, at] = lowest
            inside = at + 1 < used[every, part]
            if parts == 1:  # every row closes the gap and loses a column
                columns = np.arange(grid.shape[2] - 1)
                source = (columns + (columns > at[:, None]))[:, None, :]
                if len(columns) > 1:
                    grid, ranks = np.take_along_axis(grid, source, axis=2), np.take_along_axis(ranks, source, axis=2)
                else:
                    grid[:, :, 1], ranks[:, :, :] = -1, NONE
                used -= 1
            else:
                self._close(grid, ranks, used, every[inside], part[inside], at[inside] + 1)
                if not inside.all():  # the pair's right half is the first of the next segment
                    self._drop_first(grid, ranks, used, following, preceding, least, every[~inside], part[~inside])
            # only the pairs to the right and to the left of the merged id are new
            n = used[every, part]
            over = np.where(at + 1 < n, part, following[every, part])
            right = np.where(over >= 0, grid[every, over, np.where(at + 1 < n, np.minimum(at + 1, grid.shape[2] - 1), 0)], -1)
            back = np.where(at > 0, part, preceding[every, part])
            before = np.where(at > 0, at - 1, used[every, back] - 1)
            left = np.where(back >= 0, grid[every, back, before], -1)
            found = self.table.find(np.concatenate([lowest, left]), np.concatenate([right, lowest]))
            ranks[every, part, at] = found[: len(rows)]
            had = np.flatnonzero(back >= 0)
            ranks[had, back[had], before[had]] = found[len(rows) :][had]
            least[every, part] = ranks[every, part].min(axis=1)
            far = had[at[had] == 0]
            least[far, back[far]] = ranks[far, back[far]].min(axis=1)
        return out

    @staticmethod
    def _close(grid: np.ndarray, ranks: np.ndarray, used: np.ndarray, rows: np.ndarray, part: np.ndarray, gap: np.ndarray) -> None:
        """Remove one cell of a segment of each of the rows."""
        columns = np.arange(grid.shape[2])
        source = np.minimum(columns + (columns >= gap[:, None]), grid.shape[2] - 1)
        for cells, empty in ((grid, -1), (ranks, NONE)):
            moved = np.take_along_axis(cells[rows, part], source, axis=1)
            moved[:, -1] = empty
            cells[rows, part] = moved
        used[rows, part] -= 1

    def _drop_first(self, grid: np.ndarray, ranks: np.ndarray, used: np.ndarray, following: np.ndarray, preceding: np.ndarray, least: np.ndarray, rows: np.ndarray, part: np.ndarray) -> None:
        """Remove the first cell of the segment after `part`; an emptied segment leaves the row's chain."""
        after = following[rows, part]
        self._close(grid, ranks, used, rows, after, np.zeros(len(rows), np.int64))
        least[rows, after] = ranks[rows, after].min(axis=1)
        gone = used[rows, after] == 0
        rows, part, after = rows[gone], part[gone], after[gone]
        further = following[rows, after]
        following[rows, part] = further
        on = further >= 0
        preceding[rows[on], further[on]] = part[on]

    def _stretches(self, text: str) -> list[str]:
        """Cut before single blanks between visible characters: no match of the pattern crosses such a place."""
        parts = text.split(" ")
        if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            return parts[:1] + [" " + p for p in parts[1:]]
        out, start, at = [], 0, text.find(" ", 1)
        while at != -1:
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                out.append(text[start:at])
                start = at
            at = text.find(" ", at + 1)
        return [*out, text[start:]] if start < len(text) else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text. What short stretches become is kept in a memo of bounded bytes."""
        cut = [self._stretches(t) for t in texts]
        here, new = {}, []
        for stretch in set().union(*cut) if cut else ():
            known = self.memo.get(stretch)
            if known is None and (known := self.memo.old.get(stretch)) is not None:
                self.memo.remember(stretch, known)
            if known is None:
                new.append(stretch)
            else:
                here[stretch] = known
        found = [self.pattern.findall(s) for s in new]
        pieces = {p: None for f in found for p in f}
        for p, ids in zip(pieces, self.merge([p.encode() for p in pieces]), strict=True):
            pieces[p] = ids.astype("<u4").tobytes()
        for stretch, f in zip(new, found, strict=True):
            here[stretch] = b"".join([pieces[p] for p in f])
            self.memo.remember(stretch, here[stretch])
        return [b"".join(map(here.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.word.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


_tools: dict[bytes, ByteBpe] = {}


def tool_for(data: bytes, pattern: str) -> ByteBpe:
    """This process's encoder for a rank file's bytes, made once; memos of other operators are released."""
    only(OWNER)
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _tools:
        _tools[key] = ByteBpe(read_ranks(data), pattern)
    return _tools[key]


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian uint32) and decoded (bytes, from the ids) of each row.

    Null text: no ids. Null or repeated doc_id: kept as they are, a row each. Empty table: no rows. Texts and pieces of any
    length are encoded whole. Other columns, whatever their names, are ignored. The rank file is broadcast; it is a fixed
    vocabulary, checked against 64 MB."""
    ship(docs.sparkSession)
    with open(rank_path, "rb") as f:
        data = f.read(64 << 20)
        if f.read(1):
            raise ValueError("a rank file of over 64 MB isn't broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tool_for(shared.value, pattern)
        for rows in row_slices(batches, 1024):
            ids = tool.encode([t or "" for t in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array([tool.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids binary, decoded binary")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
