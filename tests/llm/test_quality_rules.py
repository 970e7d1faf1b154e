import re

import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa

from skuflow.llm import quality_rules as rules
from skuflow.llm.queries import QUERIES
from skuflow.llm.text_arrays import Texts, Words, span_hash

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept int, score string"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_follow_the_words_of_each_text(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "é", "b#", "ccc", "\n", "the", "\t", "x|y", "　"], rng.integers(0, 60))) for _ in range(150)]
    texts += [None, "", " \n\n ", "same line\nsame line\n\n", "w " * 9, "w " * 40, " "]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in rules.quality_rules(docs, docs.where("doc_id < 50"), max_target=40).collect()}
    for k, text in enumerate(texts):
        row, want = got[k], counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, text
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.base_failed and row.kept)


def test_score_is_the_mean_log_ratio(spark):
    texts = ["good words of a clean text", "good words again", "### junk *** ###", "### junk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in rules.quality_rules(docs, docs.where("doc_id < 2")).collect()}

    def grams(text):
        words = Words(Texts.of(pa.array([text])))
        return [int(b) for bucket, _ in rules.ngram_buckets(words, words.hashes(), rules.BUCKETS) for b in bucket]

    raw, target = np.full(rules.BUCKETS, 0.5), np.full(rules.BUCKETS, 0.5)
    for k, text in enumerate(texts):
        for bucket in grams(text):
            raw[bucket] += 1
            target[bucket] += k < 2
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for k, text in enumerate(texts):
        assert abs(got[k] - ratio[grams(text)].mean()) < 1e-8
    assert min(got[0], got[1]) > max(got[2], got[3])


def test_every_trusted_document_is_in_the_target(spark):
    """If all are trusted, target and raw are the same, however many they are; ids given twice count once."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('own', id, ' word', id % 7, ' of a text') AS text")
    found = rules.quality_rules(docs, docs.union(docs))
    assert found.where("score != 0").count() == 0
    counts = rules.ngram_counts(docs, rules.trusted_ids(docs.union(docs), "doc_id"), "doc_id", "text", rules.BUCKETS)
    assert counts.where("raw != target").count() == 0


def test_no_rows_and_no_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rules.quality_rules(empty, empty).collect() == []
    one = spark.createDataFrame([(None, "ten words " * 3)], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in rules.quality_rules(one, empty).collect()] == [(None, 0.0)]


def test_query(spark):
    rows = QUERIES["op1_quality_rules"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts(texts[row.doc_id])
    assert len(rows) == len(texts)


def test_span_hash_depends_on_bytes_only():
    data = np.frombuffer(b"abcdefghijk-abcdefghijk", np.uint8)
    a, b = span_hash(data, np.array([0, 12, 0]), np.array([11, 23, 10]))[[0, 1]]
    assert a == b and len(set(span_hash(data, np.arange(12), np.full(12, 12)).tolist())) == 12


def test_rows_without_id_count_as_raw_only(spark):
    rows = [(k if k % 3 else None, f"word{k % 7} word{k % 5} and more") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    trusted = spark.createDataFrame([(k,) for k in (1, 2, 4, None)], "doc_id long")
    counts = rules.ngram_counts(docs, rules.trusted_ids(trusted, "doc_id"), "doc_id", "text", rules.BUCKETS).collect()
    alone = rules.ngram_counts(docs.where("doc_id in (1, 2, 4)"), rules.trusted_ids(trusted, "doc_id"), "doc_id", "text", rules.BUCKETS).collect()
    every = rules.ngram_counts(docs.withColumn("doc_id", F.lit(1).cast("long")), rules.trusted_ids(trusted, "doc_id"), "doc_id", "text", rules.BUCKETS).collect()
    assert {r.bucket: r.raw for r in counts} == {r.bucket: r.raw for r in every}
    assert {r.bucket: r.target for r in counts if r.target} == {r.bucket: r.raw for r in alone}
