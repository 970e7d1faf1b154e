import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.llm import exact_search


def brute(rows, k=5, scale=256):
    """Every query against every other row, in whole numbers of Python; rows are (id, vector) in stored order."""
    usable = [(n, i, [math.floor(scale * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is None or i % 50:
            continue
        found = [(sum(a * b for a, b in zip(q, v, strict=True)), j) for m, j, v in usable if m != n and len(v) == len(q)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, rank, j, score) for rank, (score, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5, parts=6):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, shard int").repartition(parts)
    found = exact_search.top_k(table, F.col("vec_id") % 50 == 0, k)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()), key=str)


def test_against_brute_force_with_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "SMALL_SHARD", 400)  # several shards, two levels of merging
    monkeypatch.setattr(exact_search, "FAN", 3)
    rng = random.Random(2)
    few = [[rng.choice([-1.0, -0.004, 0.0, 0.004, 0.5]) for _ in range(4)] for _ in range(6)]
    rows = [(k, rng.choice(few)) for k in range(300)]  # many equal scores
    rows += [(0, few[0]), (7, few[0]), (150, few[1]), (-50, few[2]), (None, few[0]), (None, [1.0] * 4)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan")] * 4), (1150, [float("inf"), 0.0, 0.0, 0.0]), (1200, []), (1201, []), (1250, [1.0, 2.0]), (1251, [3.0, 4.0]), (1300, [2.0] * 3)]
    assert run(spark, rows) == brute(rows)


def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "SMALL_SHARD", 2000)
    monkeypatch.setattr(exact_search, "FIRST", 8)
    rng = np.random.default_rng(3)
    rows = [(k, [0.25] * 8 if k % 3 == 0 else rng.normal(size=8).tolist()) for k in range(1500)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e2, 1e4, 1e6])
def test_products_beyond_single_and_double_digits_are_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=3) * size).tolist()) for k in range(120)]
    assert run(spark, rows, parts=2) == brute(rows)


def test_a_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e300]), (1, [1e10])])


def test_few_candidates_and_no_rows(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [0.5]), (50, [0.25])]) == brute([(0, [1.0]), (1, [0.5]), (50, [0.25])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_search.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []


def test_number_types_are_proven():
    assert exact_search.exact_kind(256, 256, 64) is np.float32
    assert exact_search.exact_kind(2**15, 2**15, 64) is np.float64
    assert exact_search.exact_kind(2**30, 2**30, 2) is object
