"""Compressed full-text index over integer symbols: suffix array, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than all others."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class BitRank:
    """Packed bits with a count before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts of patterns by backward search; symbols are 0 .. sigma - 1 and the text ends in its only 0."""

    def __init__(self, text: np.ndarray) -> None:
        self.order = suffix_array(text)
        column = text[self.order - 1]
        counts = np.bincount(text)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, BitRank]] = []
        for shift in range(max(1, int(len(counts) - 1).bit_length()) - 1, -1, -1):
            bit = (column >> shift) & 1
            self.levels.append((shift, BitRank(bit)))
            column = np.concatenate([column[bit == 0], column[bit == 1]])

    def _rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi in the transform."""
        start = np.zeros(len(symbol), np.int64)
        for shift, bits in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b, c = bits.ones(start), bits.ones(lo), bits.ones(hi)
            start = np.where(one, bits.zeros + a, start - a)
            lo = np.where(one, bits.zeros + b, lo - b)
            hi = np.where(one, bits.zeros + c, hi - c)
        return lo - start, hi - start

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol on the left."""
        lo, hi = self._rank(symbol, lo, hi)
        return self.first[symbol] + lo, self.first[symbol] + hi

    def matches(self, text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which width-symbol windows of the streamed text occur at least twice, with their intervals.

        `ends` are the windows' last positions. The matching statistic of a window grows by a
        symbol at a time from its end; a window whose interval holds one suffix is given up.
        """
        alive = np.arange(len(ends))
        symbol = text[ends]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        for k in range(1, width):
            twice = hi - lo > 1
            alive, lo, hi = alive[twice], lo[twice], hi[twice]
            if not len(alive):
                break
            lo, hi = self.step(text[ends[alive] - k], lo, hi)
        twice = hi - lo > 1
        return alive[twice], lo[twice], hi[twice]
