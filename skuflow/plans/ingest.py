"""Document ingestion: pages to stored chunks, one chained job per collection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skuflow.operators.documents import chunk_boundary, chunk_fixed, clean_pages, first_per_chunk_id
from skuflow.operators.near_duplicates import dedup_keep_first
from skuflow.operators.retrieval import collection_of, embed_chunks, write_collection
from skuflow.session import checkpointed
from skuflow.sources.readers import read_documents

CHUNK_ORDER = ["source", "page", "chunk_index"]


def chunks_of(pages: DataFrame, mode: str = "fixed") -> DataFrame:
    """Clean chunks of pages with their collection; one row per chunk id.

    Chunk ids repeat only where (source, page) repeats. A read of these two columns finds such pages; in
    most corpora there are none, and texts go straight through. Only texts of repeated pages are shuffled
    to pick the first chunk per id.
    """
    split = {"fixed": chunk_fixed, "boundary": chunk_boundary}[mode]
    clean = clean_pages(pages)
    keys = ["source", "page"]
    counts = pages.groupBy(*keys).agg(F.count("*").alias("rows"))
    repeated = checkpointed(counts.where(F.col("rows") > 1).select(*keys))
    if repeated.isEmpty():
        chunks = split(clean)
    else:
        # The table is written, so the planner knows its bytes and sends a small one to the tasks.
        once = split(clean.join(repeated, keys, "left_anti"))
        first = first_per_chunk_id(split(clean.join(repeated, keys, "left_semi")), CHUNK_ORDER)
        chunks = once.unionByName(first)
    return chunks.withColumn("collection", collection_of(F.col("doc_type")))


def unique_chunks(pages: DataFrame, mode: str = "fixed") -> DataFrame:
    """Chunks without near-duplicates of earlier ones, each collection by itself.

    Texts are cleaned and cut once; hashing and the final selection read the written chunks.
    """
    return dedup_keep_first(checkpointed(chunks_of(pages, mode)), CHUNK_ORDER, within="collection")


def ingest(
    spark: SparkSession, pages: DataFrame, path: str, version: int, mode: str = "boundary",
    load: Callable[[], Callable[[pd.Series], pd.Series]] | None = None,
) -> None:
    """Clean, chunk, remove near-duplicates, embed and upsert into the collections stored at ``path``.

    ``load`` gives a model that maps texts to vectors; they are stored as ``embedding``. Without it none are stored.
    """
    chunks = unique_chunks(pages, mode).withColumn("version", F.lit(version).cast("long"))
    write_collection(spark, embed_chunks(chunks, load) if load else chunks, path)


def ingest_folder(spark: SparkSession, directory: str, path: str, version: int, **options) -> DataFrame:
    """``ingest`` of the text files of a folder; returns the files that could not be read."""
    pages, rejects = read_documents(spark, directory)
    ingest(spark, pages.select("source", "page", "text"), path, version, **options)
    return rejects
