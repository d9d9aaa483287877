"""Words of Arrow string columns as numpy arrays: places and 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and \\x09-\\x0D, as in [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 18
_powers: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_SPAN, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def settled(run: Callable) -> Callable:
    """run, a function over Arrow batches, which gives back what its process no longer needs when a task ends: workers are used again."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return inner


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, most: int = _SPAN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows of about `most` bytes: first row, row after the last, offsets from 0, bytes."""
    off, data = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def places(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and the index of each row's first word (one more at the end)."""
    blank = _BLANK[data]
    start = ~blank
    start[1:] &= blank[:-1]
    end = ~blank
    end[:-1] &= blank[1:]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = ~blank[first]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = ~blank[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    power, inverse = _tables()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, side="right")))
        a, b = starts[i:j] - base, ends[i:j] - base
        if b[-1] > _SPAN:  # one word longer than the tables
            h = 0
            for k in range(base, int(ends[i]), _SPAN):
                piece = data[k : min(k + _SPAN, ends[i])].astype(np.uint64) + np.uint64(1)
                h = (h * 31 + int((piece * power[: len(piece)]).sum(dtype=np.uint64))) % (1 << 64)
            out[i] = h
        else:
            total = np.zeros(b[-1] + 1, dtype=np.uint64)
            np.cumsum((data[base : base + b[-1]].astype(np.uint64) + np.uint64(1)) * power[: b[-1]], out=total[1:])
            out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k of the hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + h[i : i + n]
    return mix(out)
