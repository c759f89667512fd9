"""Encoding and decoding with a sentencepiece model of the merge type (BPE with byte fallback) by a prefix table.

The merges leave every prefix of a text with one last piece, whatever follows. Two facts make a table of it: a run of pieces is the
encoding of its text exactly if each two neighbours stay apart when they are merged alone, and each part of an encoding is the encoding
of its own text. So of all pieces that end at a place, found by an Aho-Corasick automaton, exactly one stays apart from
the last piece of the prefix before it; that one is stored, and the ids are recovered from the text's end backwards.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import PieceCache, only, row_slices
from scorewright.shipping import ship

BLANK = "▁"
#: Whose memos the encoders' are, see common.only.
OWNER = "piece_bpe"
#: Verdicts on pairs of pieces that are remembered (about 100 bytes each); beyond it all are dropped and found again.
VERDICTS = 400_000
INFINITE = float("inf")
PROBES = ["a b", "  a  b ", "\ta\n\nb", "①ﬁ é é", "　x y", " ", "▁x", "<s></s><0x41>", "The  quick   brown​fox.", "\x00­﻿"]


class PieceBpe:
    """Encoder and decoder of one model. The better of two merges is that of the higher score, of equal ones the leftmost."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end_id, size = library.eos_id(), library.vocab_size()
        self.ids, self.costs, self.bytes, self.shown = {}, {}, {}, [b""] * size
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.shown[i] = bytes([int(piece[1:-1], 16)])
            elif library.is_unused(i):
                raise ValueError("models with unused pieces aren't supported")
            elif not library.is_control(i) and not library.is_unknown(i):
                self.ids[piece], self.costs[piece] = i, -library.get_score(i)
                self.shown[i] = piece.replace(BLANK, " ").encode()
            elif library.is_unknown(i):
                self.shown[i] = library.decode([i]).encode()
        self.led = {i for p, i in self.ids.items() if p[0] == BLANK}  # of these the first of a text loses its blank
        if len(self.bytes) < 256:
            raise ValueError("only models with byte fallback are supported")
        self.merges = {p: c for p, c in self.costs.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        self.tables = []
        for piece in self.ids:
            self.tables.append({})
            self.automaton.add_word(piece, (len(piece), piece, self.tables[-1]))
        self.automaton.make_automaton()
        self.verdicts, self.histories = 0, {}
        #: Pieces have blanks at their start only, so a text may be cut before each run of blanks; where no piece has a line end, beside it too.
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("models with blanks inside pieces aren't supported")
        self.cuts_lines = not any("\n" in p for p in self.ids)
        self.stretch = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if self.cuts_lines else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.bare = PieceCache(self._coded, OWNER)
        self.after_blank = PieceCache(lambda word: self._coded(BLANK + word), OWNER)
        for probe in PROBES:
            if library.normalize(probe) != BLANK + probe.replace(" ", BLANK) or self.encode(probe) != array("I", library.encode(probe)).tobytes():
                raise ValueError("models that rewrite text, or of another type, aren't supported")

    def history(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Costs of the merges that make the piece from its characters, and its last and first part before each of them and at the end;
        None if merging the piece's text makes something else."""
        if piece not in self.histories:
            parts = list(piece)
            costs, lasts, firsts = [], [parts[-1]], [parts[0]]
            while len(parts) > 1:
                cost, at = min((self.merges.get(a + b, INFINITE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if cost == INFINITE:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                costs.append(cost)
                lasts.append(parts[-1])
                firsts.append(parts[0])
            found = (costs, lasts, firsts) if len(parts) == 1 else None
            if piece not in self.ids:  # a character without a piece: there are too many to remember
                return found
            self.histories[piece] = found
        return self.histories[piece]

    def apart(self, before: str, piece: str) -> bool:
        """Whether no merge crosses from one to the other when both are merged together. before: '' at the start of a text."""
        right = self.history(piece)
        if right is None or not before:
            return right is not None
        costs, lasts, _ = self.history(before)
        others, _, firsts = right
        i = j = 0
        while True:
            crossing = self.merges.get(lasts[i] + firsts[j], INFINITE)
            left_next = costs[i] if i < len(costs) else INFINITE
            right_next = others[j] if j < len(others) else INFINITE
            if crossing < left_next and crossing <= right_next:
                return False
            if left_next == right_next == INFINITE:
                return True
            if left_next <= right_next:
                i += 1
            else:
                j += 1

    def _verdict(self, before: str, piece: str, table: dict) -> bool:
        if self.verdicts >= VERDICTS:
            for other in self.tables:
                other.clear()
            self.verdicts = 0
        self.verdicts += 1
        table[before] = found = self.apart(before, piece)
        return found

    def last_pieces(self, text: str) -> list[str]:
        """The last piece of each prefix; '' where it is a character without a piece."""
        last = [""] * len(text)
        for end, (length, piece, table) in self.automaton.iter(text):
            if last[end]:
                continue
            start = end - length
            before = (last[start] or text[start]) if start >= 0 else ""
            fits = table.get(before)
            if fits is None:
                fits = self._verdict(before, piece, table)
            if fits:
                last[end] = piece
        return last

    def _coded(self, text: str) -> bytes:
        """Ids (little-endian uint32) of one stretch, from the prefix table backwards."""
        last, ids, at = self.last_pieces(text), [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece:
                ids.append(self.ids[piece])
                at -= len(piece)
            else:
                ids.extend(self.bytes[b] for b in reversed(text[at].encode()))
                at -= 1
        ids.reverse()
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text without an end id. What short stretches become is kept in memos of bounded bytes."""
        if not text:
            return b""
        if BLANK in text or not self.cuts_lines:
            return b"".join(map(self.bare.__getitem__, self.stretch.findall(BLANK + text.replace(" ", BLANK))))
        out, known, after = [], self.bare, self.after_blank
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(known["\n"])
                first, *words = line.split(" ")
                if first and all(words):
                    out.append(known[first])
                    out.extend(map(after.__getitem__, words))
                elif line:
                    out.extend(map(known.__getitem__, self.stretch.findall(line.replace(" ", BLANK))))
            else:
                words = line.split(" ")
                if all(words):
                    out.extend(map(after.__getitem__, words))
                else:
                    out.extend(map(known.__getitem__, self.stretch.findall(BLANK + line.replace(" ", BLANK))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids, control ids standing for nothing. Byte ids that are no valid text become what the library makes of them."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            text = b"".join(map(self.shown.__getitem__, numbers)).decode()
        except UnicodeDecodeError:
            return self.library.decode(numbers)
        first = next((i for i in numbers if self.shown[i]), None)
        return text[1:] if first in self.led else text


_tools: dict[bytes, PieceBpe] = {}


def tool_for(model: bytes) -> PieceBpe:
    """This process's encoder for a model's bytes, made once; memos of other operators are released."""
    only(OWNER)
    key = hashlib.sha256(model).digest()
    if key not in _tools:
        _tools[key] = PieceBpe(model)
    return _tools[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and decoded (text, from the ids) of each row.

    Null or empty text: the end id alone. Null or repeated doc_id: kept as they are, a row each. Empty table: no rows. Texts and stretches
    of any length are encoded whole, in time proportional to their length. Equal texts have equal ids. Other columns, whatever
    their names, are ignored. The model is broadcast; it is a fixed vocabulary, checked against 64 MB."""
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read(64 << 20)
        if f.read(1):
            raise ValueError("a model of over 64 MB isn't broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tool_for(shared.value)
        end = np.array([tool.end_id], "<u4").tobytes()
        for rows in row_slices(batches, 1024):
            ids = [tool.encode(t or "") + end for t in rows.column(1).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), arrays, pa.array([tool.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>, decoded string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    decimal = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), decimal.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
