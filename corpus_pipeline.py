"""A corpus from raw documents to token ids: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import byte_bpe, decontamination, language_id, line_chunks, simhash
from skuflow.llm.tables import crc_of, documents, free_names, read_table
from skuflow.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without a text, or without a letter in it, go."""
    language, score = free_names(docs.columns, "language", "score")
    model = language_id.train(docs, crc_of("doc_id", 3) != 1, "doc_id", "text", "lang")
    found = language_id.identify(docs, model, "text", language, score)
    return found.where(F.col(language) != language_id.UNKNOWN).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are taken out; a document of which no word is left goes. ``n_chars`` follows the text."""
    total, removed = free_names(docs.columns, "lines", "removed")
    found = line_chunks.remove_repeats(docs, "doc_id", "text", total, removed)
    kept = found.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    (matches,) = free_names(docs.columns, "matches")
    found = decontamination.benchmark_matches(docs, read_table(spark, sf_dir, "benchmark"), matches=matches)
    return found.where(F.size(matches) == 0).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again.

    A column of the documents that is called like one of the new ones gives way to it.
    """
    vocabulary = byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY)))
    kept = [c for c in docs.columns if c != "text" and c.lower() not in ("ids", "n_tokens", "restored")]
    raw, decoded = free_names([*kept, "text", "ids", "n_tokens", "restored"], "raw", "decoded")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias(raw)
    given = docs.select(*[f"`{c}`" for c in kept], "text", digest)
    found = byte_bpe.decode(byte_bpe.encode(given, vocabulary), vocabulary, bytes_col=decoded)
    restored = (F.sha2(decoded, 256) == F.col(raw)).alias("restored")
    return found.select(*[f"`{c}`" for c in kept], "ids", F.size("ids").cast("long").alias("n_tokens"), restored)


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: SQL can't express the hashes and models of the stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
