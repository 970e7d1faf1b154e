"""Language of every document: first the family, then one-versus-one linear support vector machines within it.

Features are the square roots of hashed byte trigram counts, at unit length; letters A-Z are lowered and what is no
letter counts as a space. Machines between families choose the family; machines between each two languages of
that family choose the language. All of them are fitted by dual coordinate descent on a bounded sample of documents
with a known language, the same number for each language, chosen by hash of the id. Every language is learned: the bound is
``MAX_TRAIN`` documents in all, or ``LEAST_TRAIN`` of each language where that is more.

Defined cases: a null text and one without a letter give ``und`` with score 0; a language that no family lists is a
family of its own, or shares one with its neighbours in the alphabet if there are more than ``OWN_FAMILIES`` of them; with one known language all others fall to it; with none every document is ``und``. A null id is
passed through and never learned from. Repeated rows get the same result. Only id, text and, to learn, the language
column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.llm.text_arrays import Texts, pieces

UNKNOWN = "und"
#: Hashed trigram buckets.
DIMENSIONS = 1 << 12
#: Documents the machines are fitted on at most, over all languages, and of each language where the first would leave
#: it fewer; their sparse features are gathered on the driver.
MAX_TRAIN, LEAST_TRAIN = 4_000, 20
#: Families that languages which no family lists make up at most.
OWN_FAMILIES = 32
#: Rows whose dense counts a task holds.
ROWS = 1024
COST, EPOCHS, SHARPNESS = 10.0, 30, 2.0

#: Language families, by code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc ast",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.full(256, 32, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def families_of(languages: set[str]) -> dict[str, str]:
    """The family of each language."""
    others = sorted(languages - _FAMILY.keys())
    size = max(1, -(-len(others) // OWN_FAMILIES))
    return {name: _FAMILY[name] for name in languages & _FAMILY.keys()} | {name: others[k // size * size] for k, name in enumerate(others)}


def trigram_counts(texts: Texts) -> np.ndarray:
    """One row of hashed trigram counts per text; trigrams that are spaces only are left out."""
    n, out = len(texts), np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(texts.data) < 3:
        return out
    letters = _LETTER[texts.data]
    grams = letters[:-2] | (letters[1:-1] << 8) | (letters[2:] << 16)
    inside = grams != 0x202020
    for shift in (1, 2):
        border = texts.bounds[1:-1] - shift
        inside[border[(border >= 0) & (border < len(inside))]] = False
    owner = np.repeat(np.arange(n), np.diff(texts.bounds))[: len(grams)][inside]
    bucket = (grams[inside] * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(owner * DIMENSIONS + bucket, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def features(texts: Texts) -> np.ndarray:
    x = np.sqrt(trigram_counts(texts))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letter = np.zeros(len(texts.data) + 1, np.int64)
    lowered = _LETTER[texts.data]
    np.cumsum((lowered >= 97) & (lowered < 123), out=ascii_letter[1:])
    out = ascii_letter[texts.bounds[1:]] > ascii_letter[texts.bounds[:-1]]
    for at in np.flatnonzero(~out):
        out[at] = any(map(str.isalpha, texts.data[texts.bounds[at] : texts.bounds[at + 1]].tobytes().decode()))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent in a fixed order; y is 1 or -1."""
    norms = (x * x).sum(1) + 1 / (2 * COST)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(x[i] @ w) - 1 + alpha[i] / (2 * COST)
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Machines(NamedTuple):
    """One weight column per pair of names."""

    names: list[str]
    weights: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean soft vote for each name; one name alone gets 1."""
        if len(self.names) == 1:
            return np.ones((len(x), 1))
        out = np.zeros((len(x), len(self.names)))
        margins = x @ self.weights
        for column, (a, b) in enumerate(combinations(range(len(self.names)), 2)):
            p = 1 / (1 + np.exp(-SHARPNESS * margins[:, column]))
            out[:, a] += p
            out[:, b] += 1 - p
        return out / (len(self.names) - 1)


def fit_machines(x: np.ndarray, labels: np.ndarray) -> Machines:
    names = sorted(set(labels))
    columns = []
    for a, b in combinations(names, 2):
        rows = np.flatnonzero((labels == a) | (labels == b))
        columns.append(fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
    return Machines(names, np.column_stack(columns) if columns else np.zeros((x.shape[1], 0), np.float32))


class LanguageModel(NamedTuple):
    families: Machines | None
    languages: dict[str, Machines]

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        language, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = np.flatnonzero(has_letter(texts))
        if self.families is None or not len(known):
            return language, score
        x = features(texts)[known]
        votes = self.families.votes(x)
        chosen = votes.argmax(1)
        for at, family in enumerate(self.families.names):
            rows = np.flatnonzero(chosen == at)
            if len(rows):
                inner = self.languages[family].votes(x[rows])
                language[known[rows]] = np.array(self.languages[family].names, object)[inner.argmax(1)]
                score[known[rows]] = np.round(votes[rows, at] * inner.max(1), 6)
        return language, score


def fit(x: np.ndarray, labels: np.ndarray) -> LanguageModel:
    if not len(labels):
        return LanguageModel(None, {})
    families = families_of(set(labels))
    family = np.array([families[label] for label in labels], object)
    return LanguageModel(fit_machines(x, family), {f: fit_machines(x[family == f], labels[family == f]) for f in sorted(set(family))})


def train(docs: DataFrame, fold: Column, id_col: str, text_col: str, lang_col: str, limit: int = MAX_TRAIN) -> LanguageModel:
    """Fit on ``limit`` documents of the fold at most, or ``LEAST_TRAIN`` per language, spread evenly by hash of the id."""
    rows = docs.where(fold & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()
    if not counts:
        return LanguageModel(None, {})
    each = max(limit // len(counts), LEAST_TRAIN)
    # Rows are thinned where they lie, so that no task gathers more than a few times a language's share.
    parts = F.create_map(*[F.lit(v) for lang, n in counts for v in (lang, min(1.0, (1.2 * each + 20) / n))])
    hashed = F.xxhash64(F.lit("language sample"), id_col)
    rows = rows.where(F.pmod(hashed, F.lit(1_000_000)) / 1_000_000.0 < parts[F.col(lang_col)])
    rows = rows.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", F.xxhash64("text"))
    rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", rows=ROWS):
            texts = Texts.of(piece.column("text"))
            known = has_letter(texts)
            x = trigram_counts(texts)
            sparse = [np.flatnonzero(row) if ok else [] for row, ok in zip(x, known, strict=True)]
            counted = [row[at] for row, at in zip(x, sparse, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("lang"), piece.column("n"), pa.array(sparse, pa.list_(pa.int32())), pa.array(counted, pa.list_(pa.float32()))],
                ["lang", "place", "at", "n"],
            )

    found = rows.select("lang", "n", "text").mapInArrow(extract, "lang string, place int, at array<int>, n array<float>")
    sample = found.toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    x = np.zeros((len(sample), DIMENSIONS), np.float32)
    for row, (at, n) in enumerate(zip(sample["at"], sample["n"], strict=True)):
        x[row, at.values.to_numpy()] = n.values.to_numpy()
    x = np.sqrt(x)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    used = length[:, 0] > 0
    return fit((x / np.maximum(length, 1e-9))[used], np.array(sample["lang"].to_pylist(), object)[used])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; the new names must be free."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, rows=ROWS):
            names, scores = model.predict(Texts.of(piece.column(text_col)))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(scores)], [*piece.schema.names, language, score])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{columns}, `{language}` string, `{score}` double")
