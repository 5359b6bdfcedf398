"""Numpy helpers over the UTF-8 bytes of an Arrow text column.

Texts are handled in pieces of about a quarter of a megabyte (a longer text is a piece of its own), so the
memory of a task does not depend on how many rows Arrow hands over at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(inside) -> np.ndarray:
    return np.array([inside(byte) for byte in range(256)], dtype=bool)


# Words are runs of these bytes. White space and ASCII never occur inside a multi-byte character.
NOT_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, all bits depend on all bits."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)


_kept_powers = lru_cache(maxsize=1)(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of them.

    Those that a piece needs are kept, those that only a very long text needs are not.
    """
    least = PIECE * 2
    return _kept_powers(least) if n <= least else _powers(n)


class Hashes:
    """Hashes of all slices of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray) -> None:
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Of every slice of that length."""
        count = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:count]) * self.down[:count])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + sizes * np.uint64(0xD6E8FEB86659FD93))


def release() -> None:
    """Give freed memory back to the system: idle Python workers share a machine with busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(function: Callable) -> Callable:
    """The function of a ``mapInArrow`` or ``applyInArrow``, with :func:`release` at its end."""
    if inspect.isgeneratorfunction(function):

        def each(batches):
            try:
                yield from function(batches)
            finally:
                release()

        return each

    def whole(table):
        try:
            return function(table)
        finally:
            release()

    return whole


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes, and offsets of the rows in them. A null is an empty text."""
    base = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if not len(chunk):
            continue
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        held = chunk.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        low = 0
        while low < len(chunk):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
            high = min(high, len(chunk))
            yield base + low, base + high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
        base += len(chunk)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    mask = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which positions start a window of that width that lies within one text."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    low, high = offsets[:-1], offsets[1:] - width + 1
    some = high > low
    np.add.at(edge, low[some], 1)
    np.add.at(edge, high[some], -1)
    return np.cumsum(edge[:-1]) > 0


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in one of the intervals."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each interval, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and the end of each in that buffer (before its space)."""
    sizes = ends - starts
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    at = np.cumsum(sizes + 1) - sizes - 1
    out[spread(at, sizes)] = data[spread(starts, sizes)]
    return out, at + sizes
