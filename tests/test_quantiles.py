import numpy as np
import pytest

from skuflow.operators import quantiles
from skuflow.operators.row_index import with_row_index


@pytest.mark.parametrize("kind", ["normal", "ties", "wide"])
def test_exact_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "_LEAF_ROWS", 50)
    monkeypatch.setattr(quantiles, "_BINS", 16)
    draw = np.random.default_rng(2)
    values = {
        "normal": draw.normal(size=5000),
        "ties": np.concatenate([np.full(3000, 1.25), draw.normal(size=2000)]),
        "wide": np.concatenate([draw.normal(size=3000), 1e12 * draw.normal(size=10)]),
    }[kind]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(7)
    levels = [0.0, 0.02, 0.05, 0.5, 0.77, 1.0]
    np.testing.assert_allclose(quantiles.exact_quantiles(rows, "x", levels), np.quantile(values, levels), rtol=1e-12)


def test_nan_and_infinities_count_as_missing(spark):
    values = [float(v) for v in range(10_000)]
    rows = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("inf"), float("-inf"), None]], "x double")
    assert quantiles.exact_quantiles(rows, "x", [0.0, 0.5, 1.0]) == [0.0, 4999.5, 9999.0]


def test_row_index_is_consecutive(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5003 as k").repartition(6)
    indexed = sorted((r.k, r.row_index) for r in with_row_index(rows, ["k"]).collect())
    assert [i for _, i in indexed] == list(range(5000))
