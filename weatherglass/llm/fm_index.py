"""FM-index over integer sequences: suffix sort, wavelet matrix, backward search, sampled locate.

All steps work on numpy arrays for many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text, by prefix doubling. Each 0 is a separator of its own, smaller than all other
    symbols, and ties among separators follow the position; the last symbol must be 0."""
    n = len(text)
    breaks = text == 0
    count = int(breaks.sum())
    rank = text.astype(np.int64) + (count - 1)
    rank[breaks] = np.arange(count)
    order, width = np.argsort(rank, kind="stable"), 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank, width = fresh, width * 2
        if rank.max() == n - 1 or width >= 2 * n:
            return order


class WaveletMatrix:
    """Rank and access over symbols below 2 ** levels, by one packed bit row a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.rows = len(symbols), levels, []
        now = symbols.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
            self.rows.append((words, before, self.n - int(before[-1])))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.starts = np.zeros(1 << levels, np.int64)
        self.starts = self.descend(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    @staticmethod
    def _ones(row, i: np.ndarray) -> np.ndarray:
        words, before, _ = row
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & mask)

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, row in enumerate(self.rows):
            ones = self._ones(row, i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, row[2] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self.descend(symbol, i) - self.starts[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for row in self.rows:
            ones = self._ones(row, i)
            bit = (row[0][i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1
            i = np.where(bit, row[2] + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i - self.starts[symbol]


class FMIndex:
    """Index of one shard: text has symbols from 1 to alphabet, and 0 after each segment."""

    def __init__(self, text: np.ndarray, alphabet: int):
        self.n = len(text)
        if not self.n:
            return
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(alphabet).bit_length()))
        totals = np.bincount(text, minlength=1 << self.bwt.levels)
        self.before = np.concatenate(([0], np.cumsum(totals)[:-1]))
        first = np.ones(self.n, bool)
        first[1:] = text[:-1] == 0
        keep = (first | (np.arange(self.n) % SAMPLE == 0))[order]
        self.marked = WaveletMatrix(keep.astype(np.int64), 1)
        self.positions = order[keep]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (one a line, padded at the left with 0), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        if not self.n:
            return low, low
        for back in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, patterns.shape[1] - back].astype(np.int64)
            low[on] = self.before[symbol] + self.bwt.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.bwt.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            symbol, rank = self.marked.access(rows[left])
            done = symbol == 1
            found[left[done]] = self.positions[rank[done]] + steps[left[done]]
            left = left[~done]
            symbol, rank = self.bwt.access(rows[left])
            rows[left] = self.before[symbol] + rank
            steps[left] += 1
        return found
