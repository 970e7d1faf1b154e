"""The operators over their whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import byte_bpe, decontamination, exact_search, language_id, license_scan, line_chunks, pii, quality_gam, quality_rules, simhash, spelling_variants, substring_dedup, token_alignment
from skuflow.llm.oracle import ORACLE
from skuflow.llm.tables import crc_of, documents, labels, read_table

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = labels(spark, sf_dir).where(F.col("quality") == 1)
    return quality_rules.quality_rules(documents(spark, sf_dir), trusted)


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_of("doc_id", 4)
    scored = quality_gam.quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir), fold != 2)
    return scored.select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality_gam.CUT).cast("int").alias("predicted"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), crc_of("doc_id", 3)
    model = language_id.train(docs, fold != 1, "doc_id", "text", "lang")
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    tokens = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


@query
def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, removed lines, and the SHA-256 of what is left of each text (null stays null)."""
    kept = line_chunks.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.benchmark_matches(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    base = [kind.name for kind in pii.KINDS if kind.base]
    every = [kind.name for kind in pii.KINDS]
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(every).alias("spans"),
    )


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, sf_dir))
    names = [label for _, label in license_scan.PHRASES]
    starts = F.concat(*names)
    base = F.filter(F.array(*[F.when(F.size(name) > 0, F.lit(name)) for name in names]), lambda x: x.isNotNull())
    labels_of = lambda array: F.array_join(F.array_sort(F.array_distinct(array)), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.concat(base, F.col("templates.label"))).alias("labels"),
        F.round(F.coalesce(F.array_max("templates.score"), F.when(F.size(starts) > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur five times or more, after every 199th run by its hash has lost a letter."""
    words = spelling_variants.word_counts(documents(spark, sf_dir), slip=199)
    return spelling_variants.spelling_variants(words.where("n >= 5"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.token_alignment(documents(spark, sf_dir), *paths)
