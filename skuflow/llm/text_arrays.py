"""Texts of an Arrow batch as flat numpy arrays: words, lines and their hashes without a Python loop per word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. All
of these are single bytes in UTF-8, so splitting bytes splits code points at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII capitals lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words made of ASCII letters, digits and anything beyond ASCII.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_U64 = np.uint64
_M1, _M2, _M3 = _U64(0x9E3779B97F4A7C15), _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], _U64)


class Texts:
    """Bytes of several texts behind one another; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """A string column; null counts as an empty text."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(offsets):
            offsets = np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.bounds) - 1


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``limit`` bytes of text and at most ``rows`` rows, at least one row each.

    Working arrays are several times as large as the bytes, so memory is bounded by the limit and the longest text.
    """
    for batch in batches:
        sizes = np.diff(Texts.of(batch.column(text)).bounds)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            upto = min(upto, at + (rows or upto))
            yield batch.slice(at, upto - at)
            at = upto


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> _U64(30))) * _M2
    h = (h ^ (h >> _U64(27))) * _M3
    return h ^ (h >> _U64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; order matters."""
    return mix(left * _M1 + right)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; eight bytes a step, over the spans that are still unread."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    h = mix(sizes.astype(_U64) + _U64(seed) * _M1 + _M3)
    left, at = sizes, starts
    todo: np.ndarray | None = None
    while True:
        value = eight[at] & _LOW[np.minimum(left, 8)]
        if todo is None:
            h = mix((h ^ value) * _M1)
            more = left > 8
            todo = np.flatnonzero(more)
        else:
            h[todo] = mix((h[todo] ^ value) * _M1)
            more = left > 8
            todo = todo[more]
        if not len(todo):
            return h
        left, at = left[more] - 8, at[more] + 8


class Words:
    """Starts and ends of all words of some texts; ``first[i]:first[i + 1]`` are the words of text i.

    ``blank`` marks the bytes that no word holds.
    """

    def __init__(self, texts: Texts, blank: np.ndarray = SPACE):
        data, bounds = texts.data, texts.bounds
        self.texts = texts
        n = len(data)
        flag = np.ones(n + 1, bool)
        flag[:n] = blank[data]
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        inside = ~flag
        before = np.ones(n + 1, bool)
        before[1:] = flag[:-1]
        self.starts = np.flatnonzero(inside & (before | begins))
        after = np.ones(n + 1, bool)
        after[:-1] = flag[1:] | begins[1:]
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hash(self.texts.data, self.starts, self.ends, seed)


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; empty ranges give zero."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring values: by doubling, so the work grows with the logarithm."""
    if len(words) < size:
        return np.zeros(0, _U64)
    h, have, out, used = words, 1, None, 0
    while True:
        if size & have:
            out = h if out is None else chain(out[: len(h) - used], h[used:][: len(out)]) if used else h
            used += have
        if have * 2 > size:
            return out[: len(words) - size + 1]
        h, have = chain(h[:-have], h[have:]), have * 2


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts``, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def joined_words(words: Words, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words behind one another, a space between each two; their bytes, and each word's start and end there."""
    at, until = (words.starts, words.ends) if kept is None else (words.starts[kept], words.ends[kept])
    if not len(at):
        return np.zeros(0, np.uint8), at, until
    sizes = until - at
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    joined = np.full(int(ends[-1]), 32, np.uint8)
    joined[ranges(starts, sizes)] = words.texts.data[ranges(at, sizes)]
    return joined, starts, ends


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbouring values."""
    if len(values) < size:
        return values[:0]
    out, have = values, 1
    while have * 2 <= size:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = size - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
