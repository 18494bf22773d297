"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return; ``A``-``Z`` are lower-cased first. Words are hashed
to 64 bits with numpy over the whole byte buffer of a slice of rows, so no Python
object is made for a word. All functions are pure and run inside Arrow tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(_INVERSE, 1 << 16)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW, _INV


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string array; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    raw, off = buffers(column)
    start, n = 0, len(off) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = end


def words(column: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and per row the index of its first word (one more than rows).

    With ``marks`` every ASCII byte but letters and digits parts words, not white space alone.
    """
    raw, off = buffers(column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    pow_, inv = _power_tables(n + 1)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~(_MARK if marks else _SPACE)[raw]
    edge = np.diff(inside)
    breaks = off[1:-1]
    breaks = breaks[(breaks > 0) & (breaks < n)]
    cut = breaks[(inside[breaks] == 1) & (inside[breaks + 1] == 1)]
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.unique(cut)]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.unique(cut)]))
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[raw] * pow_[:n], out=run[1:])
    hashed = mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(starts, off, "left")


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and row offsets.

    A row with fewer than ``width`` words has its whole sequence as its only shingle,
    a row without words none.
    """
    hashed, first = words(column)
    count = np.diff(first)
    rows = len(count)
    made = np.maximum(count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(rows), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + first[:-1][row]
    value = np.zeros(len(row), np.uint64)
    short = (count < width)[row]
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    for k in range(width):
        word = padded[at + k]
        if short.any():
            word = np.where(short & (at + k >= first[1:][row]), U64(k + 1), word)
        value = value * U64(0x9FB21C651E98DF25) + word
        value ^= value >> U64(31)
    value = mix(value)
    out, sizes = [], np.zeros(rows, np.int64)
    bound = np.concatenate([[0], np.cumsum(made)])
    for r in np.flatnonzero(made):
        own = value[bound[r] : bound[r + 1]]
        own.sort()
        if len(own) > 1:
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        sizes[r] = len(own)
        out.append(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
