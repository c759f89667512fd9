"""Whole texts to token ids by a tokenizers file, with a memo of what each stretch between blanks becomes.

Both kinds of vocabulary here never let a token cross the place before a single blank between two visible
characters, so a text's ids are the ids of the stretches cut there, one after the other; the library itself encodes each
distinct stretch. Where white space is dropped, a stretch is also cut between a plain letter and the stops after it, and
the new words of many texts go to the library in one call.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession

from scorewright.llm.common import ENTRY_BYTES, MEMO_PIECE, PieceCache, only

#: Letters whose normal form, lower case and letter class are the same in every Unicode version, and the stops after them: a
#: plain word and its stops are always pieces of their own.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
PLAIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)")

LITTLE = sys.byteorder == "little"

#: Bytes of text whose new words go to the library together; longer texts are cut at white space.
RUN = 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in STOPS]] = True


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}



def _parts(data: bytes) -> Iterator[bytes]:
    """data, cut at white space where it is longer than RUN."""
    start = 0
    while len(data) - start > RUN and (blank := BLANK.search(data, start + RUN)):
        yield data[start : blank.start()]
        start = blank.start()
    yield data[start:] if start else data


def _packed(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    found = array("I", ids)
    if not LITTLE:
        found.byteswap()
    return found.tobytes()


#: Whose memos the encoders' are, see common.only.
OWNER = "tokens"
_encoders: dict[tuple[int, int], Encoder] = {}


class _Words(PieceCache):
    """Memo of stretches after a blank (or of all, where blanks are dropped): plain ASCII words, with or without stops, take the shortest way."""

    def __init__(self, encoder: Encoder, prefix: str, make: Callable) -> None:
        super().__init__(make, OWNER)
        self.tokenize, self.stops_of, self.prefix = encoder.library.model.tokenize, encoder.stop_ids, prefix
        self.short, self.lower = False, False  # set when the encoder has been probed

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            text = piece if piece.__class__ is str else piece.decode()
            word = text.rstrip(STOPS)
            if self.short and word.isascii() and word.isalpha():
                value = array("I", [t.id for t in self.tokenize(self.prefix + (word.lower() if self.lower else word))]).tobytes()
                if len(word) < len(text):
                    value += self.stops_of(text[len(word) :])
            else:
                value = self.make(piece)
        size = len(piece)
        if size <= MEMO_PIECE:  # as remember() does
            if self.held >= self.size:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = value
            self.held += ENTRY_BYTES + size + len(value)
        return value


class _Together(PieceCache):
    """Memo whose new pieces are made together: one asked for is None until fill() has made all that wait."""

    def __init__(self, make: Callable) -> None:
        super().__init__(make, OWNER)
        self.waiting: dict[bytes, None] = {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            self.waiting[piece] = None
        elif self.held < self.size:  # as remember() does
            self[piece] = value
            self.held += ENTRY_BYTES + len(piece) + len(value)
        else:
            self.remember(piece, value)
        return value

    def fill(self) -> dict[bytes, bytes]:
        """The values of all that waited."""
        made = self.make(list(self.waiting))
        self.waiting = {}
        for piece, value in made.items():
            self.remember(piece, value)
        return made


class Encoder:
    """kind 'blank': a blank belongs to the word after it (byte-level vocabularies). kind 'drop': white space is dropped.

    The kind is a property of the vocabulary, checked against the library on a probe when the encoder is made."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.library.get_vocab_size()
        self.drops = drops = self._ids("a b") == self._ids("a") + self._ids("b")
        if not drops and self._ids("a b") != self._ids("a") + self._ids(" b"):
            raise ValueError("this vocabulary joins text across blanks")
        self.encode = self._encode_dropping if drops else self._encode_blanks
        self.stops: dict[str, bytes] = {}
        self.plain = False
        self.cache = _Words(self, "", self._bytes)
        self.after_blank = _Words(self, "" if drops else _byte_letters()[32], lambda word: self._bytes(" " + word))
        self.letters, self.lower = _byte_letters(), self._ids("Ab") == self._ids("ab")
        probes = [b + w for b in ("", " ") for w in ("a", "the", "Nation", "éÇà", "Übergrößen", "señor", "zqxjkv", "Aa", "end.", "été,.", "a***", "no!?", "b$$$", "c-", "d`~", "f&@#", "g)]}", "h{[(", "i+=<>^|")]
        plain = all(self._plain(PLAIN.fullmatch(p)) == _packed(self._ids(p)) for p in probes)
        self.plain = plain
        self.pieces = _Together(self._made_together)
        self.cuts = drops and all(self._ids(a + stop + b) == self._ids(f"{a} {stop}{b}") for stop in STOPS for a, b in (("a", ""), ("Z", "b"), ("it's", "'s"), ("a", stop), ("e", "\u0338"), ("1b", " 1")))
        self.words, self.ends = self._word_tool() if plain and drops else (None, None)
        for memo in (self.cache, self.after_blank):
            memo.short, memo.lower = plain and LITTLE, self.lower

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, match: re.Match) -> bytes:
        """Ids of one plain word straight from the library's merge model, as normalising and splitting leave it whole, and of its stops."""
        blank, word, stops = match.groups()
        word = word.lower() if self.lower else word
        word = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        if blank and not self.drops:
            word = self.letters[32] + word
        found = _packed([t.id for t in self.library.model.tokenize(word)])
        return found + self.stop_ids(stops) if stops else found

    def stop_ids(self, stops: str) -> bytes:
        """Ids of the stops after a word; the short runs are remembered, which are few."""
        if len(stops) > 2:
            return _packed(self._ids(stops))
        if stops not in self.stops:
            self.stops[stops] = _packed(self._ids(stops))
        return self.stops[stops]

    def _bytes(self, piece) -> bytes:
        text = piece.decode() if isinstance(piece, bytes) else piece
        if match := self.plain and PLAIN.fullmatch(text):
            return self._plain(match)
        return _packed(self._ids(text))

    def _word_tool(self) -> tuple:
        """The library's merge model on words between blanks, and for each id whether it ends a word; without a mark of word ends, neither."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        mark = self.library.model.end_of_word_suffix
        if not mark:
            return None, None
        tool = Tokenizer(self.library.model)
        tool.pre_tokenizer = WhitespaceSplit()
        ends = np.zeros(self.size, bool)
        ends[[k for token, k in self.library.get_vocab().items() if token.endswith(mark)]] = True
        return tool, ends

    def _made_together(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece; those of plain words by one call for all."""
        words, made = [], {}
        for piece in pieces:
            if self.words and len(piece) <= MEMO_PIECE and (piece.isalpha() or PLAIN_WORD.fullmatch(piece.decode())):
                words.append(piece)
            else:
                made[piece] = self._bytes(piece)
        text = b" ".join(words).decode()
        text = text.lower() if self.lower else text
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters | {32: " "})
        ids = np.array(self.words.encode(text, add_special_tokens=False).ids if words else [], "<u4")
        stop = (np.flatnonzero(self.ends[ids]) + 1) * 4 if words else ids
        if len(stop) != len(words):  # the vocabulary lacks some byte, so a word may have no end
            return made | {word: self._bytes(word) for word in words}
        found, start = ids.tobytes(), 0
        for word, end in zip(words, stop.tolist(), strict=True):
            made[word] = found[start:end]
            start = end
        return made

    def _encode_dropping(self, text: str) -> bytes:
        """Little-endian uint32 ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """What encode() gives for each text; where white space is dropped, by runs of a bounded number of bytes."""
        if not self.drops:
            return [self.encode(text) for text in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        run, owners, held = [], [], 0
        for k, text in enumerate(texts):
            for part in _parts(text.encode()):
                if run and held + len(part) > RUN:
                    self._encode_run(run, owners, out)
                    run, owners, held = [], [], 0
                run.append(part)
                owners.append(k)
                held += len(part)
        if run:
            self._encode_run(run, owners, out)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _encode_run(self, run: list[bytes], owners: list[int], out: list[list[bytes]]) -> None:
        """Append the ids of each part to those of the text that owns it."""
        words, stop = [], []
        for part in self._apart(run):
            words += part.split()
            stop.append(len(words))
        found = list(map(self.pieces.__getitem__, words))
        if self.pieces.waiting:
            made = self.pieces.fill()
            found = [made[word] if value is None else value for word, value in zip(words, found, strict=True)]
        start = 0
        for owner, end in zip(owners, stop, strict=True):
            out[owner].append(b"".join(found[start:end]))
            start = end

    def _apart(self, run: list[bytes]) -> list[bytes]:
        """The parts in lower case where that is sure to be what the library makes of them, and with a blank between letters and stops.

        A letter in lower case may join a mark of U+0300 to U+036F (all have CC or CD as first byte) that its capital doesn't join."""
        if self.lower:
            run = [part if b"\xcc" in part or b"\xcd" in part else part.lower() for part in run]
        if not self.cuts:
            return run
        data = np.frombuffer(b" ".join(run), np.uint8)
        at = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
        stop = np.cumsum(np.array([len(part) + 1 for part in run], np.int64))
        stop += np.searchsorted(at, stop)
        wide = np.insert(data, at, 32).tobytes()
        return [wide[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist(), strict=False)]

    def _encode_blanks(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not all(rest) or "\t" in text or not first:
            return self._encode_runs(text)
        for line in text.split("\n"):  # a line end beside another blank joins its run
            if not line or line[0] == " " or line[-1] == " ":
                return self._encode_runs(text)
        if not text.replace("\n", "").isprintable() and any(c.isspace() and c not in " \n" for c in set(text)):
            return self._encode_runs(text)
        get = self.cache.__getitem__
        if "\n" not in text:
            return get(first) + b"".join(map(self.after_blank.__getitem__, rest))
        out, glue = [], get("\n")
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(get(first) + b"".join(map(self.after_blank.__getitem__, rest)))
        return glue.join(out)

    def _encode_runs(self, text: str) -> bytes:
        """Any text: cut only before a blank with visible characters on both sides."""
        get, out, start = self.cache.__getitem__, [], 0
        at = text.find(" ", 1)
        while at != -1:
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                out.append(get(text[start:at]))
                start = at
            at = text.find(" ", at + 1)
        out.append(get(text[start:]) if start < len(text) else b"")
        return b"".join(out)


def read_definition(spark: SparkSession, path: str):
    """The tokenizer file's text as a broadcast: a fixed vocabulary of a few megabytes, whatever the data. Checked against 64 MB."""
    with open(path, encoding="utf-8") as f:
        definition = f.read(64 << 20)
        if f.read(1):
            raise ValueError("a tokenizer file of over 64 MB isn't broadcast")
    return spark.sparkContext.broadcast(definition)


def encoder(definition: str) -> Encoder:
    """This process's encoder for a definition, made once; memos of other operators are released."""
    only(OWNER)
    key = (len(definition), hash(definition))
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]
