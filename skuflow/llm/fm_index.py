"""A compressed full-text index over word numbers: Burrows-Wheeler transform, wavelet matrix, backward search.

Suffixes are sorted by their first ``DEPTH`` symbols (prefix doubling), which is all that patterns of that length
need. The transform lies in a wavelet matrix: for each bit of the symbols one bit vector with counts per 64 bits.
Many streams are matched at once, one symbol of each per step.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64
SEPARATOR = 0


class BitVector:
    """Bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Counts of a symbol before a place, a bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        row = symbols
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int(len(row) - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
        self.start = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def count(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.start[symbols]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal ones alike."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.zeros(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


class FMIndex:
    """Index of symbols from 0 to ``size - 1``; 0 separates texts and is never matched."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        self.n, self.size = n, size
        self.ranks = [_dense(symbols)]  # by the first 1, 2, 4 ... symbols
        while (1 << len(self.ranks) - 1) < DEPTH:
            step = 1 << len(self.ranks) - 1
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - step)] = self.ranks[-1][step:] + 1
            self.ranks.append(_dense(self.ranks[-1] * (n + 1) + follow))
        self.suffixes = np.argsort(self.ranks[-1], kind="stable")
        self.matrix = WaveletMatrix(symbols[self.suffixes - 1], size)
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.first[1:])
        self._common: np.ndarray | None = None
        self._minima: list[np.ndarray] = []

    @property
    def common(self) -> np.ndarray:
        """Symbols that the suffix of each row shares with the row before, up to ``DEPTH - 1``."""
        if self._common is None:
            shared = np.zeros(self.n, np.int64)
            upper, lower = self.suffixes[:-1], self.suffixes[1:]
            for level in reversed(range(len(self.ranks) - 1)):
                a, b = upper + shared[1:], lower + shared[1:]
                inside = np.maximum(a, b) < self.n
                rank = self.ranks[level]
                same = inside & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
                same &= np.maximum(a, b) + (1 << level) <= self.n
                shared[1:] += same << level
            self._common = shared
        return self._common

    def classes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the rows that share their first ``depth`` symbols, for each row."""
        new = np.flatnonzero(self.common < depth)
        which = np.repeat(np.arange(len(new)), np.diff(np.append(new, self.n)))
        return new[which], np.append(new[1:], self.n)[which]

    def bounds(self, rows: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the rows that share their first ``depth`` symbols with each given row."""
        if not self._minima:
            table = self.common.astype(np.uint8)
            table[0] = 0
            self._minima.append(np.append(table, 0))
            while 2 << len(self._minima) - 1 <= self.n:
                last, step = self._minima[-1], 1 << len(self._minima) - 1
                self._minima.append(np.minimum(last[:-step], last[step:]))
        low, high = rows.copy(), rows + 1
        for level in reversed(range(len(self._minima))):
            step, table = 1 << level, self._minima[level]
            at = low - step + 1
            move = (at >= 1) & (table[np.clip(at, 0, len(table) - 1)] >= depth)
            low = np.where(move, low - step, low)
            move = (high + step <= self.n) & (table[np.clip(high, 0, len(table) - 1)] >= depth)
            high = np.where(move, high + step, high)
        # Steps of every size were tried once, from the largest: what is left is less than one step.
        return np.where(depth == 0, 0, low), np.where(depth == 0, self.n, high)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol and go on like those of the given rows."""
        first = self.first[symbols]
        return first + self.matrix.count(symbols, low), first + self.matrix.count(symbols, high)

    def matching_statistics(self, streams: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streams the length of the longest match that begins there, and its first row.

        ``streams`` holds the streams behind one another, the k-th ends at ``ends[k]``; symbols out of range match
        nothing. Lengths stop at ``limit``, which must be less than ``DEPTH``. Backward search takes a symbol of all
        streams at a time; where no row is left, the match is shortened to the longest one that can be extended.
        """
        starts = np.append(0, ends[:-1])
        order = np.argsort(starts - ends, kind="stable")  # the longest streams first
        at, stop = ends[order] - 1, starts[order]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        length = np.zeros(len(at), np.int64)
        out, row = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
        shorter_low, shorter_high = self.classes(limit - 1)
        remaining = ends[order] - stop
        step = 0
        while True:
            active = int(np.searchsorted(-remaining, -step, "left"))
            if not active:
                return out, row
            at, low, high, length = at[:active], low[:active], high[:active], length[:active]
            full = length == limit
            high = np.where(full, shorter_high[low], high)
            low = np.where(full, shorter_low[low], low)
            length = length - full
            symbol = streams[at]
            known = (symbol > 0) & (symbol < self.size)
            safe = np.where(known, symbol, 0)
            new_low, new_high = self.extend(safe, low, high)
            found = known & (new_low < new_high)
            lost = np.flatnonzero(known & ~found & (length > 0))
            if len(lost):  # the longest part of the match that still can be extended, by halving
                least, most = np.zeros(len(lost), np.int64), length[lost]
                while (most - least > 1).any():
                    middle = (least + most) // 2
                    a, b = self.extend(safe[lost], *self.bounds(low[lost], middle))
                    least, most = np.where(a < b, middle, least), np.where(a < b, most, middle)
                length[lost] = least
                new_low[lost], new_high[lost] = self.extend(safe[lost], *self.bounds(low[lost], least))
                found[lost] = new_low[lost] < new_high[lost]
            low, high = np.where(found, new_low, 0), np.where(found, new_high, self.n)
            length = np.where(found, length + 1, 0)
            out[at], row[at] = length, low
            at = at - 1
            step += 1
