"""Cleaning, chunking, shingles and MinHash."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skuflow.functions import fixed_values as fv
from skuflow.operators import documents
from skuflow.plans import ingest

PAGES = "source string, page int, text string"


def words(count, seed=0):
    draw = np.random.default_rng(seed)
    return " ".join("w%d" % n for n in draw.integers(0, 10 ** 6, count))


def python_shingles(text):
    parts = text.lower().split()
    return {" ".join(parts[i:i + 4]) for i in range(max(1, len(parts) - 3))}


def test_clean_and_drop_empty(spark):
    rows = spark.createDataFrame([("a", 0, "  x\n\n\n\ny   z \n"), ("b", 0, " \n \n"), ("c", 0, "")], PAGES)
    assert [tuple(r) for r in documents.clean_pages(rows).collect()] == [("a", 0, "x\n\ny z")]


@pytest.mark.parametrize(
    "name, kind",
    [("PO_0001.pdf", "PO"), ("old_po_1.pdf", "unknown"), ("Purchase_x.pdf", "PO"), ("catalog_1.pdf", "catalog"),
     ("Supplier.pdf", "catalog"), ("misc.pdf", "unknown"), ("po_catalog.pdf", "PO")],
)
def test_doc_type(spark, name, kind):
    assert spark.range(1).select(documents.doc_type(F.lit(name))).first()[0] == kind


@pytest.mark.parametrize("length", [1, 200, 1400, 1599, 1600, 1601, 2999, 3000, 3001, 50_000])
def test_fixed_chunks_cover_the_text(spark, length):
    text = "".join(chr(97 + i * i % 26) for i in range(length - 1)) + "é"
    rows = documents.chunk_fixed(spark.createDataFrame([("PO_1.pdf", 0, text)], PAGES)).orderBy("chunk_index").collect()
    expected = [text[0:1600]]
    start = 1400
    while start + 200 < length:
        expected.append(text[start:start + 1600])
        start += 1400
    assert [r.text for r in rows] == expected
    assert [r.chunk_id for r in rows] == [f"PO_1.pdf_p0_c{i}" for i in range(len(expected))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60))
def test_boundary_chunks(text, size):
    overlap = size // 4
    chunks = documents.split_at_boundaries(text, size, overlap, fv.CHUNK_SEPARATORS)
    assert all(0 < len(chunk) <= size for chunk in chunks)
    letters = re.sub(r"[^ab]", "", text)
    joined = "".join(chunks)
    assert joined.count("a") >= letters.count("a") and joined.count("b") >= letters.count("b")
    assert all(chunk in text for chunk in chunks)


def test_boundary_prefers_paragraphs():
    text = "first part.\n\nsecond part. third part"
    assert documents.split_at_boundaries(text, 30, 0, fv.CHUNK_SEPARATORS) == ["first part.", "second part. third part"]


def test_boundary_overlap():
    # Pieces carry the space before them, and it counts until the chunk is trimmed.
    chunks = documents.split_at_boundaries("aa bb cc dd ee", 8, 3, fv.CHUNK_SEPARATORS)
    assert chunks == ["aa bb cc", "cc dd", "dd ee"]


@pytest.mark.parametrize("text", ["one", "one two three", "a b c d", "a b c d e a b c d", "Up  low\n x Y z"])
def test_shingles(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(documents.shingle_array(F.col("text")).alias("s")).first()
    assert sorted(row.s) == sorted(python_shingles(text))


def test_minhash_estimates_jaccard(spark):
    base = words(300).split()
    texts = [" ".join(base), " ".join(base[30:] + words(30, 9).split()), words(300, 4)]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    signed = {r.chunk_id: np.array(r.signature) for r in documents.minhash_signature(chunks).collect()}
    sets = [python_shingles(t) for t in texts]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(np.mean(signed[f"c{i}"] == signed[f"c{j}"]) - true) < 0.15


def test_repeated_page_keeps_first_chunk_per_id(spark):
    pages = spark.createDataFrame([("PO_1.pdf", 0, "b text"), ("PO_1.pdf", 0, "a text"), ("PO_2.pdf", 0, "c")], PAGES)
    rows = sorted((r.chunk_id, r.text) for r in ingest.chunks_of(pages).collect())
    assert rows == [("PO_1.pdf_p0_c0", "a text"), ("PO_2.pdf_p0_c0", "c")]


def test_a_text_is_split_once(spark):
    """Every mention of the words would split the text again, five shingles' words each."""
    rows = spark.createDataFrame([("a", "x y z")], "chunk_id string, text string")
    for column in (documents.shingle_array(F.col("text")), documents.shingle_hashes(F.col("text"))):
        plan = rows.select(column.alias("found"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1


def test_signatures_of_repeated_ids_and_missing_texts(spark):
    texts = [("a", "one two three four five six"), ("a", "Seven"), ("b", ""), ("c", None), ("d", "one two three four five six seven")]
    rows = spark.createDataFrame(texts, "chunk_id string, text string")
    found = {r.chunk_id: r.signature for r in documents.minhash_signature(rows, 7).collect()}
    numbers = documents.shingle_rows(rows).select("chunk_id", documents.shingle_number(F.col("shingle")).alias("x")).collect()
    assert set(found) == {"a", "b", "d"}
    for name, signature in found.items():
        own = [r.x for r in numbers if r.chunk_id == name]
        assert signature == [min((x * a + b) % documents.MINHASH_PRIME for x in own) for a, b in documents.minhash_factors(7)]
    values = np.array([0, 1, 2**31 - 2, 2**31 - 1, 2**31, 2 * (2**31 - 1), 2**62 - 1])
    assert documents._modulo(values.copy()).tolist() == (values % documents.MINHASH_PRIME).tolist()
