"""Features against pandas, and the number helpers."""

import datetime
import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import half_up, number_text, signed_text
from skuflow.operators import features, forecast, profile


def months(count, start=2020):
    return [date(start + i // 12, i % 12 + 1, 1) for i in range(count)]


@pytest.fixture(scope="module")
def demand(spark):
    draw = np.random.default_rng(3)
    rows = []
    for sku, count in (("A-1", 30), ("B-2", 14), ("C-3", 1), ("D-4", 5)):
        for period in months(count):
            units = float(draw.integers(0, 6) * 10)
            rows.append((sku, period, "name", "ABC—"[len(rows) % 4], "web", units + 5, 5.0, units, units * 2))
    schema = (
        "sku_id string, period date, product_name string, abc_class string, channel string, units_sold double, "
        "units_returned double, net_units double, revenue double"
    )
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def test_features_of_a_short_series(spark):
    """Fourteen months of one SKU, with values worked out by hand."""
    units = [10.0, 20.0, 60.0, 0.0, 30.0, 30.0, 90.0, 10.0, 20.0, 30.0, 40.0, 50.0, 15.0, 0.0]
    months = [datetime.date(2023 + (8 + i) // 12, (8 + i) % 12 + 1, 1) for i in range(14)]  # from September 2023
    rows = [("A", m, "name", "B", "web", u, 0.0, u, u) for m, u in zip(months, units)]
    schema = (
        "sku_id string, period date, product_name string, abc_class string, channel string, units_sold double, "
        "units_returned double, net_units double, revenue double"
    )
    found = {r.period: r for r in features.sku_features(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(found) == months[1:]  # the first month has none before it
    second, fifth, eighth, last = (found[months[i]] for i in (1, 4, 7, 13))
    assert (second.lag_1, second.lag_3, second.lag_6, second.roll_mean_3, second.roll_mean_6) == (10.0, None, None, None, None)
    assert (second.month, second.quarter, second.is_high_season, second.abc_enc) == (10, 4, 1, fv.ABC_WEIGHTS["B"])
    assert (fifth.lag_1, fifth.lag_3, fifth.is_high_season) == (0.0, 20.0, 1)
    # 20, 60 and 0 before it: mean 80/3, squares of the differences 400/9, 10000/9 and 6400/9, over two.
    assert fifth.roll_mean_3 == pytest.approx(26.6666667) and fifth.roll_std_3 == pytest.approx(30.5505046)
    assert (eighth.lag_6, eighth.month, eighth.quarter, eighth.is_high_season) == (20.0, 4, 2, 0)
    assert eighth.roll_mean_6 == pytest.approx(230.0 / 6) and eighth.yoy_growth == 0.0
    assert last.yoy_growth == -1.0 and found[months[12]].yoy_growth == 0.5  # 20 to 0, and 10 to 15


def test_growth_from_zero(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (5.0, None), (6.0, 4.0), (-1.0, 0.0)], "a double, b double")
    found = [r[0] for r in rows.select(features.growth(F.col("a"), F.col("b"))).collect()]
    assert found == [math.inf, 0.0, 0.0, 0.5, -math.inf]


def test_forecast_points_per_sku(demand):
    points = forecast.forecast_fallback(demand, horizon=4)
    assert {r["count"] for r in points.groupBy("sku_id").count().collect()} == {4}
    assert points.where("lower_ci > forecast or forecast > upper_ci or lower_ci < 0").count() == 0


def test_unknown_sku_gives_no_rows(demand):
    assert forecast.forecast_fallback(demand.where("sku_id = 'none'")).count() == 0


def test_folds_by_month_and_by_row(demand):
    table = features.sku_features(demand)
    for split in (forecast.cv_folds(table), forecast.cv_folds_by_row(table)):
        parts = {(r.fold, r.part): r["count"] for r in split.groupBy("fold", "part").count().collect()}
        assert set(parts) == {(f, p) for f in (1, 2, 3) for p in ("train", "test")}
        assert parts[1, "train"] < parts[2, "train"] < parts[3, "train"]
    by_row = forecast.cv_folds_by_row(table).groupBy("fold", "part").count().collect()
    size = table.count() // 4
    assert {r["count"] for r in by_row if r.part == "test"} == {size}


def test_average_rank_matches_pandas(spark):
    draw = np.random.default_rng(5)
    # One group holds most rows.
    frame = pd.DataFrame({"g": draw.choice(["hot", "a", "b"], 500, p=[0.8, 0.1, 0.1]), "v": draw.integers(0, 9, 500)})
    frame["id"] = range(500)
    ranked = profile.average_rank(spark.createDataFrame(frame), "g", "v", "r").toPandas().set_index("id")["r"]
    expected = frame.set_index("id").groupby("g")["v"].rank()
    pd.testing.assert_series_equal(ranked.sort_index(), expected, check_names=False)


def test_standardize_constant_column(spark):
    rows = profile.standardize(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double"), ["a", "b"])
    assert [(r.a_z, r.b_z) for r in rows.orderBy("b").collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_number_texts(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.0,), (1234567.891,)], "x double")
    x = F.col("x")
    found = [tuple(r) for r in rows.select(number_text(x), number_text(x, 1), signed_text(x), half_up(x, 2)).collect()]
    assert found == [
        ("3", "2.5", "+3", 2.5), ("-2", "-2.5", "-2", -2.5), ("0", "0.0", "+0", 0.0),
        ("1234568", "1234567.9", "+1234568", 1234567.89),
    ]
