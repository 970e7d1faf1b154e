"""Best k matches of every query row in a corpus, exact, without forming all pairs as rows.

Every task scores a block of queries against a block of the corpus in numpy and hands on only its own
best k per query; a ranking over those candidates gives the result. A matrix product gives bounds of all
distances, with a margin for its rounding; the pairs that can still be among the best are computed
directly. Queries of a checked size are broadcast and the corpus stays in its partitions. Larger query
sets are cut into blocks, and each query block meets each corpus block in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK_ROWS = 8192
QUERY_BLOCK_BYTES = 64 << 20
CORPUS_BLOCK_ROWS = 65536
CORPUS_BLOCK_BYTES = 128 << 20
_MATRIX_CELLS = 1_000_000
_EXACT_CELLS = 1_000_000


def _best(candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = candidates.sort_values(["query_id", "distance", "match_id"], kind="stable")
    return ordered[ordered.groupby("query_id", sort=False).cumcount() < k]


class Vectors(NamedTuple):
    """Ids, points as rows of an array, and groups of a block."""

    ids: np.ndarray
    points: np.ndarray
    group: np.ndarray | None

    @classmethod
    def of_pandas(cls, rows: pd.DataFrame, name: str) -> Vectors:
        group = rows["group"].to_numpy() if "group" in rows else None
        return cls(rows[name].to_numpy(), np.stack(rows["embedding"].to_numpy()), group)

    @classmethod
    def of_arrow(cls, rows: pa.Table, name: str) -> Vectors:
        vectors = rows["embedding"].combine_chunks()
        if vectors.null_count or len(pc.unique(pc.list_value_length(vectors))) != 1:
            raise ValueError("vectors must be of one length and not null")
        group = rows["group"].to_numpy() if "group" in rows.column_names else None
        return cls(rows[name].to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), group)


def _exact(left: np.ndarray, right: np.ndarray, left_at: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs, from their differences."""
    out = np.empty(len(left_at))
    step = max(1, _EXACT_CELLS // max(1, left.shape[1]))
    for at in range(0, len(out), step):
        difference = left[left_at[at:at + step]] - right[right_at[at:at + step]]
        out[at:at + step] = (difference * difference).sum(axis=1)
    return out


def _best_of_block(queries: Vectors, corpus: Vectors, k: int, best: pd.DataFrame | None = None) -> pd.DataFrame | None:
    """The best ``k`` rows of each query among ``best`` and the corpus, which is read in pieces.

    Rows beyond a query's k-th best so far are never candidates, so that few are held.
    """
    points, query_ids = queries.points.astype(np.float64), queries.ids
    lengths = (points * points).sum(axis=1)
    # A product of d terms is off by at most about d + 2 roundings of values of this size.
    rounding = 2.0 * (points.shape[1] + 4) * np.finfo(float).eps
    step = max(1, _MATRIX_CELLS // max(1, len(points)))
    place = pd.Index(query_ids) if len(query_ids) else None
    limit = _limits(best, place, len(points), k)
    for start in range(0, len(corpus.ids), step):
        others = corpus.points[start:start + step].astype(np.float64)
        other_lengths = (others * others).sum(axis=1)
        middle = lengths[:, None] + other_lengths[None, :] - 2.0 * points @ others.T
        margin = rounding * (np.sqrt(lengths)[:, None] + np.sqrt(other_lengths)[None, :]) ** 2
        high = middle + margin
        if queries.group is not None:
            high[queries.group[:, None] != corpus.group[start:start + step][None, :]] = np.inf
        near = np.isfinite(high) & (middle - margin <= limit[:, None])
        if high.shape[1] > k and not np.isfinite(limit).all():
            near &= middle - margin <= np.partition(high, k - 1, axis=1)[:, k - 1, None]
        query_at, row_at = np.nonzero(near)
        if not len(query_at) and best is not None:
            continue
        found = pd.DataFrame(
            {
                "query_id": query_ids[query_at],
                "match_id": corpus.ids[start:start + step][row_at],
                "distance": _exact(points, others, query_at, row_at),
            }
        )
        best = _best(found if best is None else pd.concat([best, found]), k)
        limit = _limits(best, place, len(points), k)
    return best


def _limits(best: pd.DataFrame | None, place: pd.Index | None, queries: int, k: int) -> np.ndarray:
    """The distance of each query's k-th best row; infinite where it has fewer, and where query ids repeat."""
    limit = np.full(queries, np.inf)
    if best is not None and len(best) and place is not None and place.is_unique:
        kth = best[best.groupby("query_id", sort=False).cumcount() == k - 1]
        at = place.get_indexer(kth["query_id"])
        limit[at[at >= 0]] = kth["distance"].to_numpy()[at >= 0]
    return limit


def best_matches(queries: DataFrame, corpus: DataFrame, k: int, match: bool, block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """(query_id, match_id, distance, rank): the ``k`` smallest squared distances, lower match id first on ties.

    ``queries`` has ``query_id``, ``corpus`` has ``match_id``, both have ``embedding``; with ``match`` only rows with
    equal values of ``group`` match. An empty corpus gives no rows.
    """
    id_types = {"query_id": dict(queries.dtypes)["query_id"], "match_id": dict(corpus.dtypes)["match_id"]}
    schema = f"query_id {id_types['query_id']}, match_id {id_types['match_id']}, distance double"
    size_of = F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))
    rows, size = queries.agg(F.count("*"), size_of).first()
    query_blocks = max(1, math.ceil(rows / block_rows), math.ceil(size / QUERY_BLOCK_BYTES))
    if query_blocks == 1:
        candidates = _against_broadcast(queries, corpus, k, match, schema)
    else:
        candidates = _block_by_block(queries, corpus, k, match, schema, query_blocks, size_of)
    ranking = Window.partitionBy("query_id").orderBy("distance", "match_id")
    return candidates.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def _against_broadcast(queries: DataFrame, corpus: DataFrame, k: int, match: bool, schema: str) -> DataFrame:
    # At most one block of queries comes here: its rows and bytes were counted before.
    shared = queries.sparkSession.sparkContext.broadcast(queries.toPandas())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        if block.empty:
            return
        asked, best = Vectors.of_pandas(block, "query_id"), None
        for batch in batches:
            if not batch.empty:
                best = _best_of_block(asked, Vectors.of_pandas(batch, "match_id"), k, best)
        if best is not None:
            yield best

    return corpus.mapInPandas(search, schema)


def _block_by_block(
    queries: DataFrame, corpus: DataFrame, k: int, match: bool, schema: str, query_blocks: int, size_of: Column
) -> DataFrame:
    rows, size = corpus.agg(F.count("*"), size_of).first()
    corpus_blocks = max(1, math.ceil(rows / CORPUS_BLOCK_ROWS), math.ceil(size / CORPUS_BLOCK_BYTES))
    every_corpus_block = F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1)))
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    left = queries.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn(
        "corpus_block", every_corpus_block
    )
    right = corpus.withColumn(
        "corpus_block", F.pmod(F.xxhash64("match_id"), F.lit(corpus_blocks)).cast("int")
    ).withColumn("query_block", every_query_block)

    def search(block: pa.Table, rows_of_block: pa.Table) -> pa.Table:
        kinds = pa.schema([block.schema.field("query_id"), rows_of_block.schema.field("match_id"), pa.field("distance", pa.float64())])
        if not block.num_rows or not rows_of_block.num_rows:
            return kinds.empty_table()
        best = _best_of_block(Vectors.of_arrow(block, "query_id"), Vectors.of_arrow(rows_of_block, "match_id"), k)
        return pa.Table.from_pandas(best, kinds, preserve_index=False)

    keys = ["query_block", "corpus_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
