"""Simple-8b: word-aligned coding of integers, vectorised both ways.

A 64-bit word holds a selector in its 4 high bits and 60 bits of payload. Selectors 2 to 15 pack a fixed count of
equally wide values, selector 1 is a run of 120 zeros, selector 0 is an escape: its payload is an index into the
exceptions, a list of values of over 60 bits. Values are cut into blocks of BLOCK; each block starts a new word, and
the word offset of every block is stored, so that blocks can be decoded alone.

Segment layout (little-endian): magic 'S8B1', then uint32 counts of values, blocks, words and exceptions, then
uint32 block offsets, uint64 words, uint64 exceptions.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: values and bits of each selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
MAGIC = b"S8B1"
BLOCK = 4096
HEAD = struct.Struct("<4s4I")


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each position, the selector that packs most values if a word starts there; a word may end short at its block's end.

    Works on bit widths as bytes: the widest of c values is a running maximum, and what lies past a block counts as narrow."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    pad = int(COUNTS.max())
    width = np.zeros((blocks, BLOCK + pad), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = np.frexp(values.astype(np.float64))[1]
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = np.zeros((blocks, BLOCK), np.uint8)  # the escape, where nothing else fits
    widest, span = width, 1
    for selector in range(15, 0, -1):  # from few values to many, so that the fullest that fits is set last
        count = int(COUNTS[selector])
        while span < count:
            step = min(span, count - span)
            longer = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=longer[:, :-step])
            widest, span = longer, span + step
        best[widest[:, :BLOCK] <= BITS[selector]] = selector
    return best.ravel()[:n]


def encode(values: np.ndarray) -> bytes:
    """A segment holding the values (unsigned, up to 64 bits)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    starts: list[int] = []
    offsets = np.zeros(blocks, np.uint32)
    if n:
        selector = _selectors(values)
        step = COUNTS[selector].astype(np.uint8).tobytes()
        for b in range(blocks):
            offsets[b] = len(starts)
            at, end = b * BLOCK, min((b + 1) * BLOCK, n)
            while at < end:
                starts.append(at)
                at += step[at]
    at = np.array(starts, np.int64)
    used = selector[at].astype(np.int64) if n else np.zeros(0, np.int64)
    words = used.astype(np.uint64) << np.uint64(60)
    escaped = at[used == 0]
    words[used == 0] |= np.arange(len(escaped), dtype=np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(used == s)
        if not len(mine):
            continue
        cell = at[mine][:, None] + np.arange(COUNTS[s])
        inside = cell < np.minimum((at[mine] // BLOCK + 1) * BLOCK, n)[:, None]
        packed = np.where(inside, values[np.minimum(cell, n - 1)], np.uint64(0)) << (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        words[mine] |= np.bitwise_or.reduce(packed, axis=1)
    return HEAD.pack(MAGIC, n, blocks, len(words), len(escaped)) + offsets.tobytes() + words.tobytes() + values[escaped].tobytes()


def decode(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of a segment, or of a range of its blocks."""
    magic, n, blocks, n_words, n_escaped = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    offsets = np.frombuffer(segment, "<u4", blocks, HEAD.size).astype(np.int64)
    at = HEAD.size + 4 * blocks
    words = np.frombuffer(segment, "<u8", n_words, at)
    exceptions = np.frombuffer(segment, "<u8", n_escaped, at + 8 * n_words)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    low, high = offsets[first_block], offsets[last_block] if last_block < blocks else n_words
    words, offsets = words[low:high], offsets[first_block:last_block] - low
    sizes = np.minimum(BLOCK, n - np.arange(first_block, last_block) * BLOCK)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    last = np.append(offsets[1:], len(words)) - 1
    counts[last] -= np.add.reduceat(counts, offsets) - sizes
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    mine = selector == 0
    out[start[mine]] = exceptions[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        cells = (words[mine][:, None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
        inside = np.arange(COUNTS[s]) < counts[mine][:, None]
        out[(start[mine][:, None] + np.arange(COUNTS[s]))[inside]] = cells[inside]
    return out
