"""Line dedup by content-defined chunks of lines.

Lines are what line feeds separate. A rolling hash over two neighbouring line hashes ends a chunk where it is a
multiple of ``DIVISOR``, so a passage is cut in the same way wherever it stands, and an inserted line moves only the
chunks next to it. A chunk has two lines at least: of boundaries on successive lines every second one counts, and a
single line at the end joins the chunk before it. A chunk whose bytes stand elsewhere in the corpus is removed, but
for its first place by (id, position); rows without id come last. The hash only brings chunks together: a chunk is
removed after its bytes have been compared with those of the first place.

Defined cases: a null text stays null, an empty one empty; a text of one line is never changed; chunks without a
word stay; rows that share id and text are one document and get the same result. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import doc_key, free_names
from skuflow.llm.text_arrays import Texts, Words, chain, pieces, span_hash

DIVISOR = 2


class Chunks:
    """Byte spans of all chunks; ``first[i]:first[i + 1]`` are those of text i. A span ends before its last line feed."""

    def __init__(self, texts: Texts):
        data, bounds = texts.data, texts.bounds
        full = np.flatnonzero(np.diff(bounds))
        feeds = np.flatnonzero(data == 10)
        # A text that ends in a line feed has an empty last line; it starts where the next text does.
        texts_of = np.concatenate([full, np.searchsorted(bounds, feeds, "right") - 1])
        order = np.argsort(np.concatenate([bounds[full] * 2, feeds * 2 + 1]), kind="stable")
        line_starts, owner = np.concatenate([bounds[full], feeds + 1])[order], texts_of[order]
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        line_ends = np.empty(len(owner), np.int64)
        line_ends[:-1] = line_starts[1:] - 1
        line_ends[last] = bounds[owner[last] + 1]
        hashes = span_hash(data, line_starts, line_ends)
        self.line_counts = np.bincount(owner, minlength=len(texts))
        at = np.arange(len(owner))
        opening = np.ones(len(owner), bool)
        opening[1:] = last[:-1]
        cut = np.zeros(len(owner), bool)
        cut[1:] = (chain(hashes[:-1], hashes[1:]) % np.uint64(DIVISOR) == 0) & ~opening[1:]
        run = np.ones(len(owner), bool)
        run[1:] = ~cut[:-1]
        begun = np.maximum.accumulate(np.where(cut & run, at, -1))
        cut &= (at - begun) % 2 == 0
        cut[:-1] &= ~last[1:]  # nothing but the last line would follow
        cut |= last
        starts = np.ones(len(owner), bool)
        starts[1:] = cut[:-1]
        self.starts, self.ends = line_starts[starts], line_ends[cut]
        self.lines = np.flatnonzero(cut) - np.flatnonzero(starts) + 1
        self.owner = owner[cut]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        words = Words(texts).starts
        worded = np.searchsorted(words, self.ends) > np.searchsorted(words, self.starts)
        self.candidates = np.flatnonzero((self.lines > 1) & worded)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, bodies: bool) -> DataFrame:
    """One row per chunk that may be removed: its hash and size, its document and position and, on request, its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            texts = Texts.of(piece.column(text_col))
            chunks = Chunks(texts)
            at = chunks.candidates
            starts, ends, owner = chunks.starts[at], chunks.ends[at], chunks.owner[at]
            columns = {
                "hash": pa.array(span_hash(texts.data, starts, ends).view(np.int64)), "size": pa.array(ends - starts),
                "id": piece.column("__id").take(pa.array(owner)), "key": piece.column("__key").take(pa.array(owner)),
                "position": pa.array(at - chunks.first[owner]),
            }
            if bodies:
                raw = texts.data.tobytes()
                columns["body"] = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(text_col).contains("\n")).select(F.col(id_col).alias("__id"), doc_key(id_col, text_col).alias("__key"), text_col)
    rows = rows.mapInArrow(run, f"hash long, size long, id {kind}, key long, position long" + ", body binary" * bodies)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "position").alias("place")
    return rows.select("hash", "size", place, *["body"] * bodies)


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, __key, repeats)``: for each document the positions that repeat an earlier chunk's hash, with that chunk's bytes."""
    whole = chunk_rows(docs, id_col, text_col, True).groupBy("hash", "size").agg(
        F.min("place").alias("owner"), F.max("place").alias("last"), F.min_by("body", "place").alias("body")
    )
    known = whole.where("owner != last").select("hash", "size", "owner", "body")
    found = chunk_rows(docs, id_col, text_col, False).join(known, ["hash", "size"]).where("place != owner")
    return found.groupBy(F.col("place.id").alias("__id"), F.col("place.key").alias("__key")).agg(
        F.collect_list(F.struct("place.position", "body")).alias("repeats")
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, the number of its lines before, and of the removed lines."""
    key, other_id, other_key, marks = free_names(docs.columns, "key", "other_id", "other_key", "marks")
    marked = docs.withColumn(key, doc_key(id_col, text_col))
    found = repeats(docs, id_col, text_col).toDF(other_id, other_key, marks)
    joined = marked.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left")
    names = docs.columns
    rows = joined.select(*[f"`{c}`" for c in names], marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            column = piece.column(text_col)
            texts = Texts.of(column)
            chunks, out = Chunks(texts), column.to_pylist()
            removed = np.zeros(len(texts), np.int64)
            marked_at = piece.column(marks)
            for at in np.flatnonzero(np.asarray(marked_at.is_valid())):
                raw = texts.data[texts.bounds[at] : texts.bounds[at + 1]].tobytes()
                low, high, base = chunks.first[at], chunks.first[at + 1], texts.bounds[at]
                bodies = {entry["position"]: entry["body"] for entry in marked_at[int(at)].as_py()}
                kept = []
                for k in range(low, high):
                    body = raw[chunks.starts[k] - base : chunks.ends[k] - base]
                    if bodies.get(k - low) == body:
                        removed[at] += chunks.lines[k]
                    else:
                        kept.append(body)
                out[at] = b"\n".join(kept).decode()
            fields = {c: piece.column(c) for c in names} | {text_col: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*fields.values(), pa.array(chunks.line_counts), pa.array(removed)], [*fields, n_lines, n_removed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{n_lines}` long, `{n_removed}` long")
