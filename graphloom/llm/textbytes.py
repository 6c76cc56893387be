"""Words and word hashes of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes handled at once inside a batch; bounds the temporaries, a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(pattern_bytes: set[int]) -> np.ndarray:
    """bool[256]: which bytes belong to a word."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Anything but space and 0x09-0x0D.
SPACE_WORDS = byte_class(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Digits, letters and everything beyond ASCII.
ALNUM_WORDS = byte_class({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``h``."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of consecutive rows with about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (length rows + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first = m.copy()
    first[1:] &= ~m[:-1]
    first[cuts] = m[cuts]
    last = m.copy()
    last[:-1] &= ~m[1:]
    last[cuts - 1] = m[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the words; ``fold`` reads A-Z as a-z."""
    values = _VALUES[_FOLD] if fold else _VALUES
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(values[data] * _powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def within(first_word: np.ndarray, length: int) -> np.ndarray:
    """Indices of the words that start ``length`` words of one row."""
    n = int(first_word[-1])
    if n < length:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, length):
        at = first_word[1:] - back
        ok[at[(at >= first_word[:-1]) & (at >= 0)]] = False
    return np.flatnonzero(ok)
