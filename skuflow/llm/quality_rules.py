"""Quality rules: counts of each text and a hashed n-gram log-likelihood ratio.

Two multinomials over the same hashed n-gram buckets are counted: one over every document (raw), one over a
trusted target. A text's score is the mean log ratio target / raw of its n-grams, so length doesn't matter.
N-grams are words, pairs of words, and pairs of word shapes (kind of the first byte and of the last two), which
tell symbol junk, capitals and menus apart even where the words themselves are rare.

Defined cases: a null text is an empty one; a text without words has score 0; repeated rows count as often as they
occur and get the same result; a null id is passed through. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.text_arrays import SPACE, Texts, Words, chain, mix, pieces, window_hashes

#: Buckets of the hashed n-grams; the model is two numbers for each, which bounds what is sent to the tasks.
BUCKETS = 1 << 16
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
SMOOTHING = 0.5
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[128:] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3


def word_shapes(words: Words) -> np.ndarray:
    data, starts, ends = words.texts.data, words.starts, words.ends
    shape = _SHAPE[data]
    return mix((shape[starts] << np.uint64(16)) | (shape[ends - 1] << np.uint64(8)) | shape[np.maximum(ends - 2, starts)])


def ngram_buckets(words: Words, hashes: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) arrays of each kind of n-gram; none reaches over the end of a text."""
    owner = words.owner
    out = [((hashes % np.uint64(buckets)).astype(np.int64), owner)]
    if len(hashes) > 1:
        same = owner[1:] == owner[:-1]
        for values in (hashes, word_shapes(words)):
            pairs = chain(values[:-1], values[1:])[same]
            out.append(((pairs % np.uint64(buckets)).astype(np.int64), owner[1:][same]))
    return out


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """bucket, raw and target: n-grams of all documents and of those whose id is in ``trusted``.

    The distinct ids are joined to the documents as a flag. Both sides are dealt out by id at every size, so the texts
    are shuffled once, and no task or driver holds all ids. Besides, one row per bucket and task is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    flags = trusted.select(F.col(id_col).alias("__id"), F.lit(True).alias("__trusted")).hint("shuffle_hash")
    known = texts.where("__doc is not null").join(flags, F.col("__doc") == F.col("__id"), "left").select("__text", "__trusted")
    # Rows without id match nothing; in the join one task would get them all.
    flagged = known.unionByName(texts.where("__doc is null").select("__text", F.lit(None).cast("boolean").alias("__trusted")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for piece in pieces(batches, "__text"):
            words = Words(Texts.of(piece.column("__text")))
            trusted = np.asarray(piece.column("__trusted").is_valid())
            for bucket, owner in ngram_buckets(words, words.hashes(), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = flagged.mapInArrow(count, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw); the table has one row per bucket, whatever the corpus."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    table = counts.toArrow()
    raw[table["bucket"].to_numpy()], target[table["bucket"].to_numpy()] = table["raw"].to_numpy(), table["target"].to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    raw, target = raw + smoothing, target + smoothing
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def trusted_ids(trusted: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """Ids of the target, each once: all, or, if the caller sets a limit, those that come first by hash."""
    known = trusted.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return known if limit is None else known.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def _repeated_words(text: bytes) -> int:
    """Words in windows found twice or more, counted over the words themselves."""
    words = [w for w in text.translate(_TO_SPACE).split(b" ") if w]
    windows = list(zip(*(words[k:] for k in range(REPEAT_WINDOW)), strict=False))
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered[at] += 1
            covered[at + REPEAT_WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


_TO_SPACE = bytes(32 if c in b"\t\n\x0b\x0c\r " else c for c in range(256))


def repeat_counts(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Repeated words of each text. Hashes only rule texts out; those with an equal pair are counted exactly."""
    out = np.zeros(len(words.counts), np.int64)
    windows = window_hashes(hashes, REPEAT_WINDOW)
    owner = words.owner
    last = owner[REPEAT_WINDOW - 1 :]
    inside = owner[: len(windows)] == last
    keys = chain(windows[inside], last[inside].astype(np.uint64))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    data, bounds = words.texts.data, words.texts.bounds
    for text in np.unique(last[inside][order[1:][twice]]):
        out[text] = _repeated_words(data[bounds[text] : bounds[text + 1]].tobytes())
    return out


def duplicate_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    data, bounds = words.texts.data, words.texts.bounds
    out = np.zeros(len(words.counts), np.int64)
    for text in range(len(out)):
        lines = data[bounds[text] : bounds[text + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            lines = [line for line in lines if line.strip(b" \t\x0b\x0c\r")]
            out[text] = len(lines) - len(set(lines))
    return out


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, bounds = words.texts.data, words.texts.bounds
    starts_char = (data & 0xC0) != 0x80
    begun = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts_char & ~SPACE[data], out=begun[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": begun[bounds[1:]] - begun[bounds[:-1]],
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeat_counts(words, hashes),
    }






def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    threshold: float = THRESHOLD, max_target: int | None = None,
) -> DataFrame:
    """Counts, score and verdict of every document; ``trusted`` holds the ids of the target in ``id_col``.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score. Two
    passes over the text: counts, then scores. The target is every trusted document, whatever their number;
    ``max_target`` is for callers that want a sample.
    """
    ratios = log_ratios(ngram_counts(docs, trusted_ids(trusted, id_col, max_target), id_col, text_col, buckets), buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            words = Words(Texts.of(piece.column(text_col)))
            hashes = words.hashes()
            total, n = np.zeros(len(words.counts)), np.zeros(len(words.counts), np.int64)
            for bucket, owner in ngram_buckets(words, hashes, buckets):
                total += np.bincount(owner, ratios[bucket], len(total))
                n += np.bincount(owner, minlength=len(total))
            counts = base_counts(words, hashes)
            ratio = np.round(total / np.maximum(n, 1), 9)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            columns = [piece.column(id_col), *map(pa.array, counts.values()), pa.array(failed), pa.array(~failed & (ratio >= threshold)), pa.array(ratio)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_failed", "kept", "score"])

    longs = ", ".join(f"{name} long" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"{id_col} {kind}, {longs}, base_failed boolean, kept boolean, score double")
