"""A compressed FM-index over integer symbols, with vectorised backward search.

The Burrows-Wheeler transform lies in a wavelet matrix: one bit vector per bit of the symbols, packed in 64-bit words with a
running count per word. The suffixes need an order by their first `depth` symbols only, which is right for patterns up to that
length.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols (at least), by prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, dtype=np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(text[order][1:] != text[order][:-1])]).astype(np.uint64)
    step = 1
    while step < depth:
        key = (rank + np.uint64(1)) << np.uint64(32)
        key[: n - step] |= rank[step:] + np.uint64(1)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1:
            break
    return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.n = len(symbols)
        self.bits: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> np.uint32(level) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-self.n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def mapped(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i ends up among the positions of its symbol; less the same for 0 it is the rank of symbol before i."""
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            ones = self._ones(level, i)
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return i


class FMIndex:
    def __init__(self, text: np.ndarray, size: int, weights: np.ndarray, depth: int) -> None:
        """text: symbols from 0 to size - 1; weights: how often each position counts."""
        n = len(text)
        order = suffix_order(text, depth)
        self.matrix = WaveletMatrix(text[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.base = self.matrix.mapped(np.arange(size), np.zeros(size, dtype=np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        self.n = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of symbol + pattern, from those of the patterns."""
        both = self.matrix.mapped(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        at = self.first[symbol] - self.base[symbol]
        return at + both[: len(low)], at + both[len(low) :]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeats(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sequence text[start:end] the longest stretches of at least `window` symbols that count twice or more: sequence, first and end (exclusive).

    All sequences are read backwards at once. Where a match can't go on, it is reported if long enough, and the search begins
    again at the last symbol of the next window that may still hold something new.
    """
    live = np.flatnonzero(ends - starts >= window)
    tail = ends[live].copy()  # end of the match, exclusive
    at = tail.copy()  # its first symbol
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), index.n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        lo, hi = index.step(text[at - 1], low, high)
        more = index.count(lo, hi) >= 2
        at = np.where(more, at - 1, at)
        low, high = np.where(more, lo, 0), np.where(more, hi, index.n)
        ended = ~more | (at == starts[live])
        report = ended & (tail - at >= window)
        if report.any():
            found.append((live[report], at[report], tail[report]))
        done = more & (at == starts[live])
        # a mismatch at symbol at - 1: the windows that hold it end at at - 1 + window at most
        next_tail = np.where(more, tail, np.minimum(tail - 1, at - 1 + window))
        done |= next_tail - starts[live] < window
        at = np.where(more, at, next_tail)
        keep = ~done
        live, tail, at, low, high = live[keep], next_tail[keep], at[keep], low[keep], high[keep]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (live, live, live)
