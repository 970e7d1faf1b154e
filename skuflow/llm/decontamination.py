"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Words are lowered; passages are windows of ``PASSAGE`` words that begin every ``STEP`` words, in benchmark items and
documents alike. Their TF-IDF vectors (hashed words, document frequencies over the whole corpus) are projected to
the leading right singular vectors of the benchmark's passages, which a randomised SVD finds in a few distributed
passes. Each document passage is compared with all benchmark passages as blocks of a matrix product; those with a
cosine of ``COSINE`` or more, less for items shorter than a passage, are candidates. A copy may still stay below that, if the item is shorter than a passage or the
benchmark larger than the space can tell apart; so the ``ANCHOR`` words in a row with the highest IDF of each item are looked
up in the documents too, which hands every unchanged copy to the check. A candidate is confirmed by the longest common subsequence of the item's
words and the words around the passage: long enough by itself, or shorter with the item's answer, its last words, in
place. So copies with changed, added or lost words are found.

A document is read where it lies: nothing of its text is shuffled. The benchmark goes to the tasks in blocks of
``BLOCK_WORDS`` words, however large it is, one step over the table for each block.

Defined cases: null and empty texts have no matches, items without a word can't be matched; null ids are passed
through; repeated rows and repeated items give the same matches again. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.text_arrays import LOWER, NO_WORD, Texts, Words, pieces, window_hashes

PASSAGE, STEP = 32, 16
#: Buckets of the hashed words; bounds the projection that is sent to the tasks (4 x RANK bytes per used bucket).
DIMENSIONS = 1 << 18
RANK, OVERSAMPLE, POWER_PASSES = 96, 16, 2
#: Least cosine of a candidate: for items of ``WHOLE`` words or more, and what shorter ones need less for each word that
#: they lack, because the rest of a passage is then other text.
COSINE, WHOLE, LESS_A_WORD = 0.7, 36, 0.016
#: Share of an item's words in the common subsequence: alone, and together with the answer.
SHARE, SHARE_WITH_ANSWER, ANSWER_SHARE = 0.8, 0.6, 0.8
ANSWER_WORDS = 5
#: Words in a row by which unchanged copies are found; shorter items are found by their cosine alone.
ANCHOR = 8
#: Words of the benchmark items that are sent to the tasks at a time.
BLOCK_WORDS = 1_000_000

MATCH = "struct<item_id: bigint, cosine: double, common_words: bigint, item_words: bigint, answer_found: boolean>"


def lowered_words(column: pa.Array) -> Words:
    texts = Texts.of(column)
    return Words(Texts(LOWER[texts.data], texts.bounds), NO_WORD)


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and text of each passage: a text's passages begin every ``STEP`` words until one reaches its end."""
    counts = words.counts
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - PASSAGE) // STEP)), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = words.first[owner] + nth * STEP
    return first, np.minimum(first + PASSAGE, words.first[owner + 1]), owner


class Space(NamedTuple):
    """Rows of the used buckets (-1: none), their weights, and their place in the latent space."""

    row: np.ndarray
    idf: np.ndarray
    axes: np.ndarray

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        return self.row[(hashes & np.uint64(len(self.row) - 1)).astype(np.int64)]

    def project(self, rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Latent vectors at unit length of neighbouring passages over the words' rows, by sums between their edges."""
        low, high = int(first[0]), int(end[-1])
        known = np.flatnonzero(rows[low:high] >= 0)
        edges = np.searchsorted(known, np.stack([first, end]) - low)
        vectors = self.axes[rows[low:high][known]]
        cuts = np.unique(edges)
        through = np.zeros((len(cuts), vectors.shape[1]), np.float32)
        inner = cuts[cuts < len(known)]
        if len(inner):
            sums = np.add.reduceat(vectors, inner, axis=0)
            through[1:] = np.cumsum(sums, axis=0)[: len(cuts) - 1]
        place = np.searchsorted(cuts, edges)
        out = through[place[1]] - through[place[0]]
        return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-6)[:, None]


def used_buckets(items: DataFrame, text_col: str) -> np.ndarray:
    """Buckets of the benchmark's words; at most ``DIMENSIONS`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(lowered_words(piece.column(text_col)).hashes() & np.uint64(DIMENSIONS - 1)).astype(np.int64))], ["bucket"])

    found = items.select(text_col).mapInArrow(run, "bucket long").distinct().toArrow()
    return np.sort(found["bucket"].to_numpy())


def document_frequencies(docs: DataFrame, text_col: str, row: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each used bucket occurs, and the number of documents; every task sends one row per bucket at most."""
    size = int(row.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for piece in pieces(batches, text_col, 1 << 20):
            words = lowered_words(piece.column(text_col))
            at = row[(words.hashes() & np.uint64(DIMENSIONS - 1)).astype(np.int64)]
            owner, used = words.owner, at >= 0
            for low in range(0, len(piece), 256):  # a flag per text and bucket, for some texts at a time
                part = used & (owner >= low) & (owner < low + 256)
                flags = np.zeros(256 * size, bool)
                flags[(owner[part] - low) * size + at[part]] = True
                total += flags.reshape(256, size).sum(0)
            n += piece.num_rows
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(filled, -1)), pa.array(np.append(total[filled], n))], ["row", "n"])

    # One row per used bucket, and one for the number of documents.
    sums = docs.select(text_col).mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    rows, values = sums["row"].to_numpy(), sums["n"].to_numpy()
    counts = np.zeros(size, np.int64)
    counts[rows[rows >= 0]] = values[rows >= 0]
    return counts, int(values[rows < 0].sum())


def _product(items: DataFrame, text_col: str, row: np.ndarray, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``A'(A right)`` for the TF-IDF passages A, as sums of the tasks' parts; row by row of the used buckets."""
    columns = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(idf), columns))
        for piece in pieces(batches, text_col):
            words = lowered_words(piece.column(text_col))
            at = row[(words.hashes() & np.uint64(DIMENSIONS - 1)).astype(np.int64)]
            for first, end, _ in zip(*passages(words), strict=True):
                rows, counts = np.unique(at[first:end][at[first:end] >= 0], return_counts=True)
                weights = counts * idf[rows]
                length = np.sqrt((weights * weights).sum())
                if length:
                    weights /= length
                    total[rows] += np.outer(weights, weights @ right[rows])
        filled = np.flatnonzero(total.any(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[filled].ravel()), columns).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(filled), lists], ["row", "v"])

    parts = items.select(text_col).mapInArrow(run, "row long, v array<double>")
    # One row per used bucket: at most 8 x DIMENSIONS x columns bytes, in one job.
    sums = parts.groupBy("row").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(columns)]).toArrow()
    out = np.zeros((len(idf), columns))
    out[sums["row"].to_numpy()] = np.column_stack([sums[f"v{k}"].to_numpy() for k in range(columns)])
    return out


def latent_space(docs: DataFrame, items: DataFrame, text_col: str, item_text: str) -> Space | None:
    """Randomised SVD of the benchmark's TF-IDF passages (Halko et al., 2011), weighted by the corpus."""
    buckets = used_buckets(items, item_text)
    if not len(buckets):
        return None
    row = np.full(DIMENSIONS, -1, np.int32)
    row[buckets] = np.arange(len(buckets))
    found, n = document_frequencies(docs, text_col, row)
    idf = np.log((n + 1) / (found + 1)) + 0.01
    basis = np.random.default_rng(11).standard_normal((len(buckets), min(RANK + OVERSAMPLE, len(buckets))))
    for _ in range(POWER_PASSES):
        basis, _ = np.linalg.qr(_product(items, item_text, row, idf, basis))
    image = _product(items, item_text, row, idf, basis)
    values, vectors = np.linalg.eigh(basis.T @ image)
    axes = (basis @ vectors[:, ::-1])[:, : min(RANK, int((values > 1e-9).sum()))]
    return Space(row, idf, (axes * idf[:, None]).astype(np.float32))


def word_masks(item: list[int]) -> dict[int, int]:
    """The places of each word of an item, as bits."""
    masks: dict[int, int] = {}
    for at, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << at
    return masks


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of that size, by bits of whole numbers."""
    full = (1 << size) - 1
    state = full
    for mask in map(masks.get, words):
        if mask:
            kept = state & mask
            state = ((state + kept) | (state - kept)) & full
    return size - state.bit_count()


class Block(NamedTuple):
    """Some benchmark items: ids, words, the latent vectors and least cosines of their passages, and sorted anchors with their item and place in it."""

    ids: list[int]
    sizes: list[int]
    masks: list[dict[int, int]]
    answers: list[dict[int, int]]
    owner: np.ndarray
    bounds: np.ndarray
    vectors: np.ndarray
    anchors: np.ndarray
    anchor_items: np.ndarray
    anchor_places: np.ndarray

    def proof(self, item: int, region: list[int]) -> tuple[int, bool] | None:
        """Length of the common subsequence and whether the answer is there, if that proves the item."""
        size = self.sizes[item]
        common = common_subsequence(self.masks[item], size, region)
        if common < SHARE_WITH_ANSWER * size:
            return None
        answer = min(ANSWER_WORDS, size)
        found = common_subsequence(self.answers[item], answer, region[len(region) // 3 :]) >= ANSWER_SHARE * answer
        return (common, found) if found or common >= SHARE * size else None


def match_piece(words: Words, space: Space, block: Block) -> list[list[dict]]:
    """The items found in each text, each once with its best passage."""
    out: list[list[dict]] = [[] for _ in words.counts]
    first, end, owner = passages(words)
    hashes = words.hashes()
    best: dict[tuple[int, int], dict] = {}
    known_rows = space.rows_of(hashes)
    for low in range(0, len(first), 256):  # so many that the vectors stay in the cache
        part = slice(low, low + 256)
        cosines = space.project(known_rows, first[part], end[part]) @ block.vectors.T
        rows, columns = np.nonzero(cosines >= block.bounds)
        for passage, column in zip((rows + low).tolist(), columns.tolist(), strict=True):
            text, item = int(owner[passage]), int(block.owner[column])
            room = block.sizes[item] // 2 + 4
            region = hashes[max(words.first[text], first[passage] - room) : min(words.first[text + 1], end[passage] + room)].tolist()
            proof = block.proof(item, region)
            if proof:
                key, cosine = (text, item), round(float(cosines[passage - low, column]), 4)
                if key not in best or proof[0] > best[key]["common_words"]:
                    best[key] = {"item_id": block.ids[item], "cosine": cosine, "common_words": proof[0], "item_words": block.sizes[item], "answer_found": proof[1]}
    for at, item in zip(*anchor_hits(hashes, block), strict=True):
        passage = int(np.searchsorted(first, at, "right")) - 1  # the last one that begins there or before
        text, size = int(owner[passage]), block.sizes[item]
        begin = at - int(block.anchor_places[item])
        if begin < words.first[text] or begin + size > words.first[text + 1] or (text, item) in best:
            continue
        proof = block.proof(item, hashes[begin : begin + size].tolist())
        if proof:
            near = space.project(known_rows, first[passage : passage + 1], end[passage : passage + 1]) @ block.vectors[block.owner == item].T
            best[text, item] = {"item_id": block.ids[item], "cosine": round(float(near.max()), 4), "common_words": proof[0], "item_words": size, "answer_found": proof[1]}
    for (text, _), match in sorted(best.items()):
        out[text].append(match)
    return out


def anchor_hits(hashes: np.ndarray, block: Block) -> tuple[list[int], list[int]]:
    """Words of the texts where an item's anchor begins, and the item."""
    if len(hashes) < ANCHOR or not len(block.anchors):
        return [], []
    windows = window_hashes(hashes, ANCHOR)
    low = np.searchsorted(block.anchors, windows)
    at = np.flatnonzero(block.anchors[np.minimum(low, len(block.anchors) - 1)] == windows)
    n = np.searchsorted(block.anchors, windows[at], "right") - low[at]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n).tolist(), block.anchor_items[np.repeat(low[at], n) + nth].tolist()


def item_anchors(words: Words, hashes: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors in order, the item of each, and for every item where its anchor begins (-1: too short for one)."""
    places = np.full(len(words.counts), -1, np.int64)
    long = np.flatnonzero(words.counts >= ANCHOR)
    if not len(long):
        return np.zeros(0, np.uint64), long, places
    weights = np.concatenate([[0.0], np.cumsum(space.idf[space.rows_of(hashes)])])
    weights = weights[ANCHOR:] - weights[:-ANCHOR]
    for item in long.tolist():
        places[item] = np.argmax(weights[words.first[item] : words.first[item + 1] - ANCHOR + 1])
    keys = window_hashes(hashes, ANCHOR)[words.first[long] + places[long]]
    order = np.argsort(keys, kind="stable")
    return keys[order], long[order], places


def blocks(items: DataFrame, space: Space, item_id: str, item_text: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; a few partitions of it at a time are on the driver."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), item_text)
    characters = known.agg(F.sum(F.length(item_text))).first()[0] or 0
    for row in known.coalesce(1 + characters // (4 * BLOCK_WORDS)).toLocalIterator():
        n = len(row[1]) // 2 + 1
        if ids and size + n > BLOCK_WORDS:
            yield _block(ids, texts, space)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if ids:
        yield _block(ids, texts, space)


def _block(ids: list[int], texts: list[str], space: Space) -> Block:
    words = lowered_words(pa.array(texts))
    hashes = words.hashes()
    first, end, owner = passages(words)
    lists = [hashes[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    masks = [word_masks(x) for x in lists]
    answers = [word_masks(x[-ANSWER_WORDS:]) for x in lists]
    vectors = space.project(space.rows_of(hashes), first, end) if len(first) else np.zeros((0, space.axes.shape[1]), np.float32)
    lacking = np.clip(WHOLE - words.counts, 0, WHOLE - STEP)
    bounds = (COSINE - LESS_A_WORD * lacking)[owner].astype(np.float32)
    return Block(ids, [len(x) for x in lists], masks, answers, owner, bounds, vectors, *item_anchors(words, hashes, space))


def benchmark_matches(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", matches: str = "matches",
) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each text; the new name must be free."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    space = latent_space(docs, items, text_col, item_text)
    out = docs.withColumn(matches, F.lit(None).cast(f"array<{MATCH}>"))
    if space is not None:
        context = docs.sparkSession.sparkContext
        shared = context.broadcast(space)
        for block in blocks(items, space, item_id, item_text):
            out = out.mapInArrow(_matcher(shared, context.broadcast(block), text_col, matches), f"{schema}, `{matches}` array<{MATCH}>")
    return out.withColumn(matches, F.array_sort(F.coalesce(matches, F.expr(f"cast(array() as array<{MATCH}>)"))))


def _matcher(space, block, text_col: str, matches: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, 1 << 20):
            at = piece.schema.get_field_index(matches)
            before = piece.column(at).to_pylist()
            found = match_piece(lowered_words(piece.column(text_col)), space.value, block.value)
            column = pa.array([(a or []) + b for a, b in zip(before, found, strict=True)], piece.schema.field(at).type)
            yield piece.set_column(at, piece.schema.field(at), column)

    return run
