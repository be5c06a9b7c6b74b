"""Vectorised word splitting and hashing over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2**64 taken from prefix
sums, then finalised with an avalanche mix, so a whole block of text costs a few numpy
passes. Work is done in blocks of about a megabyte: memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche finaliser on 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Two independent ways to hash a word: values of its bytes and the base of the polynomial.
_WAYS = ((mix(np.arange(256, dtype=np.uint64), 7), _BASE), (mix(np.arange(256, dtype=np.uint64), 31), 0xC2B2AE3D27D4EB4F))


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def _span_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[lo:hi] for each span, independent of where the span lies."""
    up, down = _pow(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo])


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, bytes, row offsets in them), rows of about ``limit`` bytes at a time. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    before[offs] = True
    starts = np.flatnonzero(~space & before[:n])
    after = np.empty(n + 1, bool)
    after[:n] = space
    after[n] = True
    after[offs[1:]] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, way: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, in runs of about four blocks of text; ``way`` 1 is independent of 0."""
    values, factor = _WAYS[way]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * BLOCK, "right")))
        base = starts[i]
        out[i:j] = _span_hash(values[data[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base, factor)
        i = j
    return out


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of values[i:i+width] for every i where the window fits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    lo = np.arange(n)
    out = np.empty(n, np.uint64)
    step = 4 * BLOCK
    for a in range(0, n, step):
        b = min(n, a + step)
        part = values[a : b + width - 1]
        out[a:b] = _span_hash(part, lo[: b - a], lo[: b - a] + width, 0xD1342543DE82EF95)
    return out


def sequence_hash(values: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, its length included."""
    h = _span_hash(values, np.array([0]), np.array([len(values)]), 0xD1342543DE82EF95)
    return mix(h + np.uint64(len(values)), 3)[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
