"""A compressed full-text index over integer symbols: FM-index on a wavelet matrix, in numpy.

The Burrows-Wheeler transform is held as one bit vector for each binary digit of the symbols, packed in
64-bit words with a running count for each word, so that a rank costs one look-up and one population
count. Backward search runs for many patterns at once, a lane for each.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be unique and smallest."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.digits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        rest = symbols.astype(np.int64)
        for shift in range(self.digits - 1, -1, -1):
            bit = ((rest >> shift) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(bit) - int(ones.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.start = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, shift in enumerate(range(self.digits - 1, -1, -1)):
            word = at >> 6
            below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][word] + np.bitwise_count(below)
            at = np.where((symbol >> shift) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of ``text``, integers from 1; symbol 0 is kept for the end."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = np.append(text, 0)
        n_symbols = int(self.text.max()) + 1
        self.order = suffix_array(self.text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=n_symbols))])
        self.last = WaveletMatrix(self.text[self.order - 1], n_symbols)

    def matching_statistics(self, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of the text itself: how many symbols that end there (``most`` at most) also occur elsewhere,
        and the suffix interval of those symbols. Backward search takes all positions one symbol to the left at a time; a
        position leaves when only its own occurrence is left."""
        length, low, high = (np.zeros(len(end), np.int64) for _ in range(3))
        lane = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(self.text))
        for j in range(most):
            symbol = self.text[end[lane] - j]
            if j:
                lo, hi = self.before[symbol] + self.last.rank(symbol, lo), self.before[symbol] + self.last.rank(symbol, hi)
            else:
                lo, hi = self.before[symbol], self.before[symbol + 1]
            many = hi - lo > 1
            lane, lo, hi = lane[many], lo[many], hi[many]
            if not len(lane):
                break
            length[lane], low[lane], high[lane] = j + 1, lo, hi
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The least ``place`` (a value for each text position) over each interval of one pattern length;
        such intervals are equal or disjoint."""
        starts, which = np.unique(low, return_index=True)
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[::2], cuts[1::2] = starts, high[which]
        values = np.append(place[self.order], np.iinfo(np.int64).max)
        return np.minimum.reduceat(values, cuts)[::2][np.searchsorted(starts, low)]
