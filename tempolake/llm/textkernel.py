"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Everything works on the
UTF-8 bytes of many documents at once; a block holds about ``BLOCK_BYTES`` of
text (one longer document makes a block of its own), so memory is bounded by
the longest document.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Arrow batches (64 MB at most, by Spark's setting) are worked off in pieces of about so many bytes.
PIECE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)
_PLACE = stream(256, 2) | np.uint64(1)
_ODD = stream(16, 3) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(1 << int(n).bit_length(), 2) | np.uint64(1)
    return _PLACE


class Block:
    """The words of some documents: ``start``/``end`` byte offsets into ``data``;
    the words of document i are ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int):
        self.data, self.offsets, self.row = data, offsets, row
        self.n = len(offsets) - 1
        inside = ~_SPACE[data]
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit multilinear hash of each word, by its bytes and length."""
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        size = self.end - self.start
        total = int(size.sum())
        at = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        data = self.data[np.repeat(self.start, size) + at]
        if lower:
            data = _LOWER[data]
        value = _BYTE[data] * _places(int(size.max()))[at]
        return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _ODD[0])


def pieces(batches):
    """The batches in parts of about PIECE_BYTES, so that what is made of a part stays small, too."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, PIECE_BYTES))
        for at in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()


def lean(run):
    """A mapInArrow function that works in pieces and gives freed memory back to the system when its
    task ends; Python workers stay for later tasks, beside the executor's own memory."""

    def task(batches):
        try:
            yield from run(pieces(batches))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named string column with nulls as empty strings and 64-bit offsets."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def blocks(text: pa.Array):
    """Blocks that cover a large_string array without nulls, in order."""
    n = len(text)
    if not n:
        return
    _, off, dat = text.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield Block(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def chain(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """An order-aware hash of two hash columns; k tells the levels apart."""
    return mix(a * _ODD[k % 16] + (b ^ (b >> np.uint64(29))) * _ODD[(k + 7) % 16] + np.uint64(k))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by start; runs that cross a document's
    end are the caller's to leave out."""
    if n > len(h):
        return np.empty(0, dtype=np.uint64)
    power, level, out, done = h, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            part = power[done : done + len(h) - n + 1]
            out = part if out is None else chain(out, part, 100 + level)
            done += level
        rest >>= 1
        if rest:
            power = chain(power[: len(power) - level], power[level:], level.bit_length())
            level *= 2
    return out


def whole(h: np.ndarray) -> np.uint64:
    """A hash of a sequence of fewer words than a shingle has."""
    out = np.full(1, len(h), dtype=np.uint64) * _ODD[5]
    for i in range(len(h)):
        out = mix(out * _ODD[6] + h[i : i + 1])
    return out[0]
