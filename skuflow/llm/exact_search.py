"""Exact top-k search by inner product: tiled matrix products of queries and shards, merged as a tree.

Vectors become whole numbers, ``floor(scale * x)``, and are written once, packed. Their rows are dealt to shards of
bounded bytes, whatever their ids; each shard's task keeps its own rows as one matrix while all query rows stream by.
A tile is a block of queries times a run of the shard's columns. The first tile is narrow; from then on only scores
above a query's k-th best so far leave a tile. What is shuffled is every vector once and every query once a shard,
then k candidates per query and shard, which are merged ``FAN`` shards at a time.

Products are exact: single or double floats where the shard's and the block's largest components prove that every
sum fits their digits, whole numbers of Python beyond that. A score that does not fit 64 bits is an error, as is a
component that doubles can't hold once scaled.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no part, neither as query nor
as candidate; vectors meet only vectors of their own length (empty ones score 0). A query's own row is no candidate,
but a repeated row with the same id is. Ties go to the smaller id, a null id last, then to the earlier stored row. A
query with fewer than k candidates gets all of them. An empty table gives no rows. Only the id and vector columns are
read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.tables import checkpointed, shuffle_partitions

#: Bytes of packed components that one task holds as its shard.
SHARD_BYTES = 32 << 20
#: Bytes from which a shard is worth a task of its own, while there are fewer shards than shuffle partitions.
SMALL_SHARD = 1 << 19
#: Scores of a tile.
TILE = 1 << 22
#: Queries in a block, and the first width of a tile.
BLOCK, FIRST = 1024, 128
#: Partial lists merged at a time.
FAN = 16

_NO_ID = np.iinfo(np.int64).max


class Block(NamedTuple):
    """Vectors of one length: a matrix with one row each, their ids (a null id as the largest number) and row numbers."""

    matrix: np.ndarray
    ids: np.ndarray
    rows: np.ndarray


def stored_vectors(vectors: DataFrame, query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Usable vectors with a row number each, packed as little-endian numbers of 2 or 8 bytes: ``row, id, asks, size, wide, packed``.

    The table is written, so that numbers and shards stay the same when a task runs again.
    """
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"),
    ).where(usable)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            with np.errstate(over="ignore"):
                flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(sizes)
            out, wide = [], []
            for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                own = flat[end - size : end]
                narrow = size == 0 or np.abs(own).max() < 2**15
                out.append(own.astype("<i2" if narrow else "<f8").tobytes())
                wide.append(not narrow)
            columns = [batch.column("id"), batch.column("asks"), pa.array(sizes.astype(np.int32)), pa.array(wide, pa.bool_()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "asks", "size", "wide", "packed"])

    packed = rows.mapInArrow(pack, "id long, asks boolean, size int, wide boolean, packed binary")
    return checkpointed(packed.select(F.monotonically_increasing_id().alias("row"), "*"))


def _blocks(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    """The vectors of a batch, one block per length, ordered by id and row."""
    sizes = batch.column("size").to_numpy()
    ids = batch.column("id").fill_null(_NO_ID).to_numpy()
    rows, wide = batch.column("row").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False)
    packed = batch.column("packed")
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        own = own[np.lexsort((rows[own], ids[own]))]
        if not wide[own].any():
            matrix = np.frombuffer(b"".join(packed[k].as_py() for k in own.tolist()), "<i2").reshape(len(own), size)
        else:
            matrix = np.empty((len(own), size))
            for k, at in enumerate(own.tolist()):
                matrix[k] = np.frombuffer(packed[at].as_py(), "<f8" if wide[at] else "<i2")
        yield Block(matrix, ids[own], rows[own])


def _largest(matrix: np.ndarray) -> int:
    return int(np.abs(matrix.astype(np.float64) if matrix.dtype.kind != "f" else matrix).max()) if matrix.size else 0


def exact_kind(left: int, right: int, size: int) -> type:
    """The plainest number type in which no sum of ``size`` products of such components can lose a digit."""
    bound = left * right * max(size, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def _as_kind(matrix: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return matrix.astype(kind)
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


class Best:
    """The best ``k`` candidates of each query of a block so far, by score, then by place in the shard."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k = k
        self.scores = np.zeros((queries, k), kind)
        self.places = np.full((queries, k), -1, np.int64)
        self.filled = np.zeros(queries, np.int64)

    def add(self, tile: np.ndarray, first: int, skip: np.ndarray) -> None:
        """Takes in the scores of all queries against the columns from ``first``; ``skip`` is each query's own place or -1.

        Places only grow, so a later score must exceed the k-th best to count.
        """
        full = self.filled == self.k
        good = np.ones(tile.shape, bool)
        good[full] = tile[full] > self.scores[full, -1:]
        own = np.flatnonzero((skip >= first) & (skip < first + tile.shape[1]))
        good[own, skip[own] - first] = False
        who, column = np.nonzero(good)
        if not len(who):
            return
        touched = np.unique(who)
        held = np.arange(self.k)[None, :] < self.filled[touched, None]
        at, rank = np.nonzero(held)
        owners = np.concatenate([touched[at], who])
        scores = np.concatenate([self.scores[touched[at], rank], tile[who, column]])
        places = np.concatenate([self.places[touched[at], rank], column + first])
        order = np.lexsort((places, -scores, owners)) if scores.dtype != object else np.array(
            sorted(range(len(owners)), key=lambda j: (owners[j], -scores[j], places[j])), np.int64)
        owners = owners[order]
        begins = np.searchsorted(owners, touched)
        rank = np.arange(len(owners)) - np.repeat(begins, np.diff(np.append(begins, len(owners))))
        taken = order[rank < self.k]
        owners, rank = owners[rank < self.k], rank[rank < self.k]
        self.scores[owners, rank], self.places[owners, rank] = scores[taken], places[taken]
        self.filled[touched] = np.minimum(np.diff(np.append(begins, len(order))), self.k)


def search_block(asked: Block, shard: Block, k: int) -> Best:
    """The best ``k`` of a shard for each query of a block; both hold vectors of one length."""
    kind = exact_kind(_largest(asked.matrix), _largest(shard.matrix), asked.matrix.shape[1])
    queries = _as_kind(asked.matrix, kind)
    best = Best(len(asked.ids), k, kind)
    order = np.argsort(shard.rows)
    at = np.minimum(np.searchsorted(shard.rows, asked.rows, sorter=order), len(order) - 1)
    skip = np.where(shard.rows[order[at]] == asked.rows, order[at], -1)
    first, width, most = 0, FIRST, max(FIRST, TILE // len(asked.ids))
    while first < len(shard.ids):
        columns = _as_kind(shard.matrix[first : first + width], kind)
        best.add(queries @ columns.T if columns.shape[1] else np.zeros((len(queries), len(columns)), kind), first, skip)
        first, width = first + width, min(2 * width, most)
    return best


_PARTIAL = "q long, query_id long, shard int, found array<struct<lost:long,id:long,row:long>>"
_FOUND = pa.list_(pa.struct([("lost", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]))


def _answers(asked: Block, shard: Block, best: Best, number: int) -> pa.RecordBatch:
    """Per query its candidates as (score negated, id, row), a null id as the largest number: they sort by rank."""
    filled = np.arange(best.k)[None, :] < best.filled[:, None]
    places = best.places[filled]
    lost = [-int(s) for s in best.scores[filled].tolist()]
    if any(not -(1 << 63) < s < 1 << 63 for s in lost):
        raise OverflowError("a score that does not fit 64 bits")
    flat = pa.StructArray.from_arrays([pa.array(lost, pa.int64()), pa.array(shard.ids[places]), pa.array(shard.rows[places])], ["lost", "id", "row"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(best.filled)).astype(np.int32)), flat)
    return pa.RecordBatch.from_arrays([pa.array(asked.rows), pa.array(asked.ids), pa.array(np.full(len(asked.ids), number, np.int32)), lists.cast(_FOUND)], ["q", "query_id", "shard", "found"])


def _partial_lists(k: int):
    """Of rows ordered by shard, corpus rows before queries: the partial lists of each query in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, shard = None, [], {}
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if numbers[begin] != number:
                    number, parts, shard = int(numbers[begin]), [], {}
                run_of = batch.slice(begin, end - begin)
                corpus = int(np.searchsorted(run_of.column("part").to_numpy(), 1))
                if corpus:
                    parts.append(run_of.slice(0, corpus))
                if corpus == run_of.num_rows:
                    continue
                if parts:
                    shard = {block.matrix.shape[1]: block for block in _blocks(pa.Table.from_batches(parts).combine_chunks())}
                    parts = []
                for at in range(corpus, run_of.num_rows, BLOCK):
                    for asked in _blocks(run_of.slice(at, min(BLOCK, run_of.num_rows - at))):
                        own = shard.get(asked.matrix.shape[1])
                        if own is not None:
                            yield _answers(asked, own, search_block(asked, own, k), number)

    return run


def _merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """The lists of each query merged ``FAN`` shards at a time, until one is left."""
    while shards > 1:
        shards = -(-shards // FAN)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
        lists = lists.groupBy("q", "query_id", F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(best)
    return lists


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest scores of each row for which ``query`` holds, against all other rows."""
    spark = vectors.sparkSession
    stored = stored_vectors(vectors, query, id_col, vector_col, scale)
    total = int(stored.agg(F.sum(F.length("packed"))).first()[0] or 0)
    shards = max(1, -(-total // SHARD_BYTES), min(shuffle_partitions(spark), -(-total // SMALL_SHARD)))
    corpus = stored.select("*", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("part"))
    asked = stored.where("asks").select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"))
    dealt = corpus.unionByName(asked).drop("asks").repartition(shards, "shard").sortWithinPartitions("shard", "part")
    lists = _merged(dealt.mapInArrow(_partial_lists(k), _PARTIAL), k, shards)
    known = lambda c: F.when(c != int(_NO_ID), c)
    ranked = lists.select(known(F.col("query_id")).alias("query_id"), F.posexplode("found").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), known(F.col("x.id")).alias("vec_id"), (-F.col("x.lost")).alias("score"))
