"""Vectorised text primitives over Arrow string columns (no per-word Python).

Texts of a batch are one byte array with document offsets; words are found by
a class table, and hashed by differences of a polynomial prefix sum modulo
2**64, so the cost per byte is a few array passes whatever the words are.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (one longer text is handled alone).
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def trim() -> None:
    """Give freed memory back to the system: Python workers stay, idle, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(work):
    """`work` (a function of batches) that trims when its batches are done."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) of at most `limit` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[0] = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)].astype(np.uint64), dtype=np.uint64)
            _powers[1] = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE)].astype(np.uint64), dtype=np.uint64)
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any byte ranges of one array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.power, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        values = _BYTE[codes] if codes.dtype == np.uint8 else mix(codes.astype(np.uint64) + np.uint64(1))
        np.cumsum(values * self.power[:n], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of non-blank bytes, no run crossing rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = word[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = word[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def crc32_of_ids(ids: np.ndarray) -> np.ndarray:
    """zlib's CRC-32 of each id's decimal text."""
    import zlib

    return np.array([zlib.crc32(str(int(i)).encode()) for i in ids], np.int64)


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def letter_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of ASCII letters and non-ASCII bytes, no run crossing rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = LETTER[data]
    edge = np.zeros(len(data), bool)
    edge[off[:-1][off[:-1] < off[1:]]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    start = np.flatnonzero(first)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:] | edge[1:]
    return start, np.flatnonzero(stop), np.searchsorted(off, start, "right") - 1
