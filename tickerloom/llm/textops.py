"""Vectorised word work on Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. None of these bytes occurs
inside a multi-byte UTF-8 sequence, so splitting bytes splits characters correctly. Each word
gets a 64-bit hash: a polynomial over per-byte random values, read off one cumulative sum, then
mixed with the length. A-Z fold to a-z through the byte table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .common import string_column

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; bounds the scratch arrays, whatever a text's length.
SEGMENT = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold) -> np.ndarray:
    folded = np.array([fold(b) for b in range(256)], np.uint64)
    return mix(folded * np.uint64(_BASE) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


def _fold(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


VALUES = _byte_values(_fold)
_IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        step = np.full(n, base, np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return tuple(out)


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each row begins and ends in them (rows + 1 offsets)."""
    column = string_column(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return bytes_, at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (rows + 1)."""
    inside = table[data]
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A 64-bit hash of each span's (folded) bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        stop = max(first + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        part = data[low : ends[stop - 1]]
        size = SEGMENT if len(part) <= SEGMENT else 1 << int(len(part)).bit_length()
        power, inverse = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=total[1:])
        s, e = starts[first:stop] - low, ends[first:stop] - low
        h = (total[e] - total[s]) * inverse[s]
        out[first:stop] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = stop
    return out


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and each row's first word's index (rows + 1)."""
    data, offsets = raw(column)
    starts, ends, rows = spans(data, offsets)
    return hash_spans(data, starts, ends), rows


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` consecutive words; shorter by width - 1."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC6A4A7935BD1E995) + hashes[k : k + n]
    return mix(out + np.uint64(width))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
