"""Substring dedup: windows of ``WINDOW`` words that also start in an earlier document, found in FM-indexes of shards.

1. Every window has an anchor, the least hash of its runs of ``ANCHOR`` words. Equal windows have equal anchors, so
   only anchors that occur in two documents matter. Neighbouring windows with one anchor make up a segment.
2. Segments of such anchors are reduced to the distinct ones, each with the least id that holds it, before any text
   moves: copies, however many, are one segment.
3. The anchor's hash assigns a segment to a shard; all places where a window can occur are then in one shard. A
   shard's distinct segments become one FM-index (Burrows-Wheeler transform in a wavelet matrix). The segments are
   streamed through it by backward search; where the matching statistics reach ``WINDOW``, the rows found are the
   places of that window, and the least id among them is the window's.
4. A document loses the words of its windows that have a smaller least id.

An anchor whose distinct segments hold more than ``ANCHOR_WORDS`` words would make a shard of any size (a passage that
a third of all documents quote, each with other words around it). Its segments are taken apart into windows that
are keyed by 128-bit hashes and aggregated like counts, so no task holds them together. The result is the same.

Defined cases: a null text is an empty one; texts with fewer words than a window lose nothing; a row without id
comes after all others and takes nothing from them; rows that share an id don't take from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.fm_index import SEPARATOR, FMIndex
from skuflow.llm.tables import checkpointed, doc_key
from skuflow.llm.text_arrays import Texts, Words, joined_words, mix, pieces, ranges, sliding_min, window_hashes

WINDOW, ANCHOR = 50, 8
#: Words of the distinct segments of an anchor that a shard takes, and words of a shard.
ANCHOR_WORDS, SHARD_WORDS = 100_000, 500_000
#: Windows of a segment that are streamed at a time; bounds the steps of a shard's backward search.
STREAM = 256
LAST = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def segments(words: Words) -> dict[str, np.ndarray]:
    """Text, anchor, first word (in its text), windows and hash of the words of each segment."""
    hashes = words.hashes()
    n = len(hashes)
    nothing = np.zeros(0, np.int64)
    if n < WINDOW:
        return dict.fromkeys(("text", "anchor", "first", "windows", "hash"), nothing)
    owner = words.owner
    least = sliding_min(window_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1)
    inside = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    if not len(inside):
        return dict.fromkeys(("text", "anchor", "first", "windows", "hash"), nothing)
    anchor, text = least[inside], owner[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(inside)))
    start = inside[begin]
    # Hash of any run of words by prefix sums of a polynomial.
    powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _ODD)))
    back = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _INVERSE)))
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers))
    run = mix((sums[start + windows + WINDOW - 1] - sums[start]) * back[start] + windows.astype(np.uint64))
    return {"text": text[begin], "anchor": anchor[begin].view(np.int64), "first": start - words.first[text[begin]], "windows": windows, "hash": run.view(np.int64)}


def segment_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``anchor, place, key, first, windows, hash``: every segment; ``place`` orders documents by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            found = segments(Words(Texts.of(piece.column(text_col))))
            text = pa.array(found.pop("text"))
            columns = {"place": piece.column("__place").take(text), "key": piece.column("__key").take(text)} | {k: pa.array(v) for k, v in found.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.where(F.length(text_col) >= 2 * WINDOW - 1).select("__place", "__key", text_col)
    return rows.mapInArrow(run, "place long, key long, anchor long, first long, windows long, hash long")


def _emit(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """Words of the wanted segments, or hashes of their windows where ``split`` is set, from the documents that stand for them."""
    lists = wanted.groupBy("place", "key").agg(F.collect_list(F.struct("anchor", "hash", "first", "windows", "least", "split")).alias("wanted"))
    joined = docs.select(F.col("__place").alias("p"), F.col("__key").alias("k"), text_col).join(lists, (F.col("p") == F.col("place")) & (F.col("k") == F.col("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            words = Words(Texts.of(piece.column(text_col)))
            raw, starts, ends = joined_words(words)
            raw = raw.tobytes()
            left, right = words.hashes(), words.hashes(1)
            rows: list[tuple] = []
            for text, entries in enumerate(piece.column("wanted").to_pylist()):
                for e in entries:
                    a = int(words.first[text]) + e["first"]
                    b = a + e["windows"] + WINDOW - 1
                    pairs = None
                    if e["split"]:
                        pairs = [{"a": x, "b": y} for x, y in zip(*(window_hashes(h[a:b], WINDOW).view(np.int64).tolist() for h in (left, right)), strict=True)]
                    rows.append((e["anchor"], e["hash"], e["least"], None if e["split"] else raw[starts[a] : ends[b - 1]], pairs))
            fields = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields, strict=True)], ["anchor", "hash", "least", "words", "pairs"])

    return joined.select(text_col, "wanted").mapInArrow(run, "anchor long, hash long, least long, words binary, pairs array<struct<a:long,b:long>>")


def least_of_windows(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each window of each text (words joined by spaces) the smallest ``least`` of the texts that hold it.

    The texts make up one FM-index and are streamed through it.
    """
    numbers: dict[bytes, int] = {}
    lists = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in text.split(b" ")], np.int64) for text in texts]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    places = ranges(np.cumsum(sizes + 1) - sizes - 1, sizes)
    symbols = np.full(int((sizes + 1).sum()), SEPARATOR, np.int64)
    symbols[places] = flat
    index = FMIndex(symbols, len(numbers) + 1)
    holder = np.repeat(np.arange(len(sizes)), sizes + 1)
    class_first, _ = index.classes(WINDOW)
    heads, which = np.unique(class_first, return_inverse=True)
    smallest = np.minimum.reduceat(least[holder[index.suffixes]], heads)
    # Streams of at most STREAM windows, each with the words that its last window needs.
    windows = sizes - WINDOW + 1
    parts = -(-windows // STREAM)
    part_text = np.repeat(np.arange(len(sizes)), parts)
    offset = ranges(np.zeros(len(parts), np.int64), parts) * STREAM
    part_windows = np.minimum(windows[part_text] - offset, STREAM)
    begin = (np.cumsum(sizes) - sizes)[part_text] + offset
    part_sizes = part_windows + WINDOW - 1
    ends = np.cumsum(part_sizes)
    length, row = index.matching_statistics(flat[ranges(begin, part_sizes)], ends, WINDOW)
    heads_of = ranges(ends - part_sizes, part_windows)
    if (length[heads_of] != WINDOW).any():
        raise AssertionError("a text of the index was not found in it")
    values = smallest[which[row[heads_of]]]
    return np.split(values, np.cumsum(windows)[:-1])


def _search_shards(texts: DataFrame, shards: int) -> DataFrame:
    """``anchor, hash, least_ids``: the windows' least ids of each segment, by the FM-index of its shard."""

    def run(table: pa.Table) -> pa.Table:
        found = least_of_windows(table["words"].to_pylist(), table["least"].to_numpy())
        return pa.table([table["anchor"], table["hash"], pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["anchor", "hash", "least_ids"])

    sharded = texts.where("words is not null").select("anchor", "hash", "least", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return sharded.groupBy("shard").applyInArrow(run, "anchor long, hash long, least_ids array<long>")


def _count_windows(texts: DataFrame) -> DataFrame:
    """The same for segments that were taken apart: windows are aggregated by their hashes."""
    rows = texts.where("pairs is not null").select("anchor", "hash", "least", F.posexplode("pairs").alias("at", "pair"))
    rows = rows.select("anchor", "hash", "least", "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    known = rows.groupBy("a", "b").agg(F.min("least").alias("window_least"))
    back = rows.join(known, ["a", "b"]).groupBy("anchor", "hash").agg(F.array_sort(F.collect_list(F.struct("at", "window_least"))).alias("found"))
    return back.select("anchor", "hash", F.col("found.window_least").alias("least_ids"))


def repeated_windows(docs: DataFrame, text_col: str, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``place, key, found``: for each document the ranges (first, n) of windows that start in an earlier one."""
    rows = segment_rows(docs, text_col)
    shared = rows.groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("anchor")
    kept = checkpointed(rows.join(shared, "anchor", "left_semi"))
    distinct = checkpointed(kept.groupBy("anchor", "hash", "windows").agg(F.min("place").alias("least"), F.min(F.struct("place", "key", "first")).alias("at")))
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("windows") + WINDOW - 1).alias("n_words"))
    total = sizes.where(F.col("n_words") <= anchor_words).agg(F.sum("n_words")).first()[0] or 0
    split = sizes.where(F.col("n_words") > anchor_words).select("anchor", F.lit(True).alias("is_split"))
    wanted = distinct.join(split, "anchor", "left").select(
        "at.place", "at.key", "at.first", "anchor", "hash", "windows", "least", F.coalesce("is_split", F.lit(False)).alias("split")
    )
    texts = checkpointed(_emit(docs, wanted, text_col))
    known = _search_shards(texts, -(-total // shard_words) + 1).union(_count_windows(texts))
    own = kept.join(known, ["anchor", "hash"])
    earlier = F.filter(F.transform("least_ids", lambda x, i: F.when(x < F.col("place"), i)), lambda i: i.isNotNull())
    single = F.transform(earlier, lambda i: F.struct((F.col("first") + i).alias("first"), F.lit(1).cast("long").alias("n")))
    whole = F.array(F.struct("first", F.col("windows").alias("n")))
    hits = own.select("place", "key", F.when(F.forall("least_ids", lambda x: x < F.col("place")), whole).otherwise(single).alias("hits"))
    return hits.where(F.size("hits") > 0).groupBy("place", "key").agg(F.flatten(F.collect_list("hits")).alias("found"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The id, n_words, n_removed and ``kept``: the words that stay, joined by single spaces."""
    marked = docs.select(id_col, text_col, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("__place"), doc_key(id_col, text_col).alias("__key"))
    found = repeated_windows(marked, text_col, **sizes)
    joined = marked.join(found, (F.col("__place") == F.col("place")) & (F.col("__key") == F.col("key")), "left").select(id_col, text_col, "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            words = Words(Texts.of(piece.column(text_col)))
            change = np.zeros(len(words) + 1, np.int64)
            marks = piece.column("found")
            for text in np.flatnonzero(np.asarray(marks.is_valid())):
                for hit in marks[int(text)].as_py():
                    first = words.first[text] + hit["first"]
                    change[first] += 1
                    change[first + hit["n"] + WINDOW - 1] -= 1
            kept = np.cumsum(change[:-1]) == 0
            raw, starts, ends = joined_words(words, kept)
            raw = raw.tobytes()
            through = np.append(0, np.cumsum(kept))[words.first]
            texts = [raw[starts[a] : ends[b - 1]] if b > a else b"" for a, b in zip(through[:-1].tolist(), through[1:].tolist(), strict=True)]
            columns = [piece.column(id_col), pa.array(words.counts), pa.array(words.counts - np.diff(through)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"{id_col} {kind}, n_words long, n_removed long, kept string")
