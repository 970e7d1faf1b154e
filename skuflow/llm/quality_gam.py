"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (length, symbols, capitals, repeats, lines). Every number is cut into bins at the
quantiles of a bounded sample of labelled rows. Boosting goes round the features in turn: a tree of at most four
leaves over one feature's bins is fitted to the gradient of the log loss and added to that feature's lookup table.
Then the pairs with the largest gain get tables of their own, boosted in the same way by trees that split one
feature and then the other. A score is the sigmoid of one table entry per feature and per pair, added up over whole
columns.

Defined cases: a null text is an empty one and is scored; without labels of both classes every score is the share of
label 1 (0.5 without labels); a label row without id or label is ignored, repeated ones count as often as they occur;
a null id is never in a fold and is passed through. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import checkpointed, first_by_hash
from skuflow.llm.text_arrays import SPACE, Texts, Words, chain, group_sums, pieces, window_hashes

#: Most labelled rows the model is fitted on; they are gathered on the driver (some 80 bytes each).
MAX_TRAIN = 50_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.15, 5.0
CUT = 0.7

FEATURES = (
    "log_words", "word_bytes", "symbols", "punctuation", "capitals", "digits", "lone_marks", "mark_endings",
    "same_as_previous", "distinct_words", "repeated_windows", "line_words", "duplicate_lines", "short_words", "full_stops",
)


def _bytes(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_DIGIT = _bytes("0123456789")
_MARK = ~(_LETTER | _DIGIT | SPACE)
_SYMBOL = _bytes("#*$%&|<>{}[]\\^~=+@_")


def text_features(texts: Texts) -> np.ndarray:
    """One row per text, one column per name in ``FEATURES``."""
    words = Words(texts)
    data, first = texts.data, words.first
    n = np.maximum(words.counts, 1).astype(float)
    length = np.maximum(np.diff(texts.bounds), 1).astype(float)
    hashes, owner = words.hashes(), words.owner
    sizes = words.ends - words.starts

    def share(flag: np.ndarray) -> np.ndarray:
        return group_sums(flag[data], texts.bounds) / length

    def of_words(flag: np.ndarray) -> np.ndarray:
        return group_sums(flag, first) / n

    letters = np.maximum(group_sums(_LETTER[data], texts.bounds), 1)
    tail = _MARK[data[words.ends - 1]] & (data[words.ends - 1] != ord(".")) & (data[words.ends - 1] != ord(","))
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    keys = chain(hashes, owner.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    new_word = np.ones(len(words), bool)
    new_word[order[1:]] = keys[order][1:] != keys[order][:-1]
    return np.column_stack([
        np.log1p(words.counts), of_words(sizes.astype(float)), share(_SYMBOL), share(_MARK),
        group_sums(_UPPER[data], texts.bounds) / letters, share(_DIGIT), of_words((sizes == 1) & _MARK[data[words.starts]]), of_words(tail),
        of_words(same), of_words(new_word), _repeats(hashes, owner, len(n), 4) / n, n / (group_sums(data == 10, texts.bounds) + 1.0),
        _line_repeats(texts), of_words(sizes <= 3), of_words(data[words.ends - 1] == ord(".")),
    ]).astype(np.float32)


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """Windows of ``size`` words that occur earlier in their text."""
    windows = window_hashes(hashes, size)
    last = owner[size - 1 :]
    inside = owner[: len(windows)] == last
    keys = chain(windows[inside], last[inside].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(last[inside][again], minlength=n).astype(float)


def _line_repeats(texts: Texts) -> np.ndarray:
    """Share of the lines that equal an earlier line of the text."""
    out = np.zeros(len(texts))
    for at in range(len(texts)):
        lines = texts.data[texts.bounds[at] : texts.bounds[at + 1]].tobytes().split(b"\n")
        out[at] = 1 - len(set(lines)) / len(lines)
    return out


class Gam(NamedTuple):
    """Lookup tables; ``edges`` and ``pair_edges`` are the bins' upper bounds of each feature."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for column, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, column])]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j]) for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return np.round(1 / (1 + np.exp(-total)), 9)


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two levels of cuts over one feature's bins: at most four leaves."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h)
    for low, high in ((0, cut), (cut, len(g))):
        if high > low:
            _, inner = _best_cut(g[low:high], h[low:high])
            for a, b in ((low, low + inner), (low + inner, high)):
                if b > a:
                    out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut of one feature, then one of the other on either side; the table and its gain."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            table, gain = np.zeros(gg.shape), 0.0
            for low, high in ((0, cut), (cut, len(gg))):
                sg, sh = gg[low:high].sum(0), hh[low:high].sum(0)
                _, inner = _best_cut(sg, sh)
                for a, b in ((0, inner), (inner, len(sg))):
                    if b > a:
                        table[low:high, a:b] = _leaf(sg[a:b], sh[a:b])
                        gain += sg[a:b].sum() ** 2 / (sh[a:b].sum() + RIDGE)
            if gain > best[0]:
                best = (gain, table.T if flip else table)
    return best[1], best[0] - g.sum() ** 2 / (h.sum() + RIDGE)


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting, first of single features, then of the pairs with the largest gain on what is left."""
    edges, pair_edges = _edges(x, BINS) if len(x) else [np.zeros(0)] * x.shape[1], _edges(x, PAIR_BINS) if len(x) else [np.zeros(0)] * x.shape[1]
    tables = [np.zeros(len(e) + 1) for e in edges]
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Gam(base, edges, tables, pair_edges, [], [])
    bins = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _line_tree(np.bincount(bins[j], y - p, len(table)), np.bincount(bins[j], p * (1 - p), len(table)))
            table += step
            total += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(pair_edges)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted((-_grid_tree(*sums(a, b))[1], a, b) for a, b in combinations(range(x.shape[1]), 2))
    pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain < 0]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            step = RATE * _grid_tree(*sums(a, b))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return Gam(base, edges, tables, pair_edges, pairs, pair_tables)


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and ``features`` of every document, written once: training and scoring both read it."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            x = text_features(Texts.of(piece.column(text_col)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(id_col), lists], [id_col, "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return checkpointed(docs.select(id_col, text_col).mapInArrow(extract, f"{id_col} {kind}, features array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def train(features: DataFrame, marks: DataFrame, fold: Column, id_col: str, label_col: str, limit: int = MAX_TRAIN) -> Gam:
    """Fit on the labelled rows of the fold, at most ``limit``; of many labels those that come first by hash of the id."""
    marks = marks.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where("__id is not null and __y is not null")
    marks = marks.where(first_by_hash(F.xxhash64("__id"), marks.count(), limit))
    rows = features.where(fold).join(marks, F.col(id_col) == F.col("__id"))
    sample = rows.select(F.xxhash64(id_col).alias("__h"), id_col, "features", "__y").orderBy("__h", id_col, "__y").limit(limit).toArrow()
    return fit_gam(_matrix(sample["features"]).astype(float), (sample["__y"].to_numpy() >= 0.5).astype(float))


def quality_classifier(
    docs: DataFrame, marks: DataFrame, train_fold: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", limit: int = MAX_TRAIN,
) -> DataFrame:
    """id and score of every document. ``train_fold`` says which ids the model may learn from."""
    features = feature_table(docs, id_col, text_col)
    model = train(features, marks, train_fold, id_col, label_col, limit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("features")).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(model.score(x))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return features.mapInArrow(score, f"{id_col} {kind}, score double")
