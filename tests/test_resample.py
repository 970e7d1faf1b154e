"""Resampling: counts, bounds, moments and repeatability."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.functions.draws import integer, normal, uniform
from skuflow.operators import resample
from skuflow.operators.row_index import with_row_index
from skuflow.plans.queries import QUERIES
from skuflow.sources import tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def demand(spark):
    return tables.demand_history(spark, SMALL).cache()


def test_draws_have_the_right_moments(spark):
    rows = spark.range(50_000).select(
        uniform(1, F.col("id"), "u").alias("u"), normal(1, F.col("id"), "n", 2.0, 3.0).alias("n"),
        integer(1, F.col("id"), "i", -5, 10).alias("i"),
    ).toPandas()
    assert abs(rows.u.mean() - 0.5) < 0.01 and 0 < rows.u.min() and rows.u.max() < 1
    assert abs(rows.n.mean() - 2.0) < 0.06 and abs(rows.n.std() - 3.0) < 0.06
    assert (rows.i.min(), rows.i.max()) == (-5, 10)
    assert abs(np.corrcoef(rows.u, rows.n)[0, 1]) < 0.02


def test_bootstrap_is_repeatable_and_bounded(demand):
    one = resample.bootstrap_demand(demand.coalesce(1), 3000, seed=7)
    two = resample.bootstrap_demand(demand.repartition(8), 3000, seed=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.count() == 3000
    assert one.where("units_sold < 0 or units_sold != floor(units_sold)").count() == 0
    means = one.agg(F.avg("units_sold")).first()[0], demand.agg(F.avg("units_sold")).first()[0]
    assert means[0] == pytest.approx(means[1], rel=0.06)


def test_bootstrap_orders(spark):
    orders = resample.bootstrap_po(tables.purchase_orders(spark, SMALL), 2000).cache()
    assert orders.count() == orders.select("po_number").distinct().count() == 2000
    assert orders.where("qty_ordered < 10").count() == 0
    assert orders.where("abs(po_value - qty_ordered * rate_per_unit) > 0.011").count() == 0


def test_copula_keeps_margins_and_correlation(demand):
    sample = resample.copula_sample(demand, 8000).toPandas()
    source = demand.select(*resample.DEMAND_MEASURES).toPandas()
    for name in resample.DEMAND_MEASURES:
        np.testing.assert_allclose(sample[name].median(), source[name].median(), rtol=0.15, atol=2)
    mine = sample[list(resample.DEMAND_MEASURES)].corr("spearman")
    theirs = source.corr("spearman")
    assert abs(mine.loc["units_sold", "revenue"] - theirs.loc["units_sold", "revenue"]) < 0.1


@pytest.mark.parametrize("target", [500, 10 ** 6])
def test_extension_has_grid_or_target_rows(demand, target):
    grid = resample.period_sku_grid(demand).count()
    rows = resample.extend_demand(demand, target).cache()
    assert rows.count() == min(grid, target)
    assert rows.where("net_units != greatest(units_sold - units_returned, 0)").count() == 0
    assert rows.select("record_id").distinct().count() == rows.count()
    assert rows.where("channel is null or month is null").count() == 0


def test_synthetic_orders(spark):
    offers = spark.createDataFrame(
        [("S1", "A", 10, 100, 5.0, 9.0), ("S2", "B", 20, 50, 1.0, 2.0)],
        "supplier_id string, sku_id string, lead_time_days int, min_order_qty int, price_low double, price_high double",
    )
    rows = resample.synthesize_po(offers, 1000).join(offers, "supplier_id").cache()
    assert rows.count() == 1000
    assert rows.where("qty < min_order_qty or qty > 4 * min_order_qty").count() == 0
    assert rows.where("unit_price < price_low or unit_price > price_high").count() == 0
    assert rows.where("abs(total - subtotal - gst) > 0.011 or abs(gst - 0.18 * subtotal) > 0.0051").count() == 0
    assert rows.where("po_date < '2022-01-01' or po_date > '2025-05-18'").count() == 0


def test_normal_scores_are_inverse(spark):
    shares = [1e-9, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.99999]
    found = spark.createDataFrame([(p,) for p in shares], "p double").select(resample.normal_score(F.col("p")).alias("z")).collect()
    for share, row in zip(shares, found, strict=True):
        assert 0.5 * math.erfc(-row.z / math.sqrt(2)) == pytest.approx(share, rel=1e-7)


def test_copula_margins_are_those_of_the_table(spark, demand):
    """Every drawn value stands in the table at the drawn share of its ranks: quantiles agree far closer than a sketch's."""
    sample = resample.copula_sample(demand, 6000).toPandas()
    source = demand.select(*resample.DEMAND_MEASURES).toPandas()
    for name in resample.DEMAND_MEASURES:
        own = np.floor(np.abs(source[name].astype(float)) + 0.5)
        assert set(sample[name]) <= set(own)
        for share in (0.05, 0.25, 0.5, 0.9, 0.99):
            value = np.quantile(sample[name], share, method="lower")
            assert (own < value).mean() - 0.03 <= share <= (own <= value).mean() + 0.03


def test_grid_rows_are_numbered_by_month_and_sku(demand):
    rows = [(r.period, r.sku_id) for r in resample.numbered_grid(demand).orderBy("row_id").collect()]
    assert rows == sorted(rows) and len(rows) == resample.month_sku_rows(demand).count()


def test_copula_of_no_rows(demand):
    assert resample.copula_sample(demand.limit(0), 5).collect() == []


@pytest.mark.parametrize("name", ["bootstrap_demand", "copula_sample", "extend_demand", "sink_csv"])
def test_demand_is_computed_once(spark, monkeypatch, name):
    seen, real = spark.sparkContext.accumulator(0), tables.demand_history

    def counted(spark, folder):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = real(spark, folder)
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(tables, "demand_history", counted)
    QUERIES[name](spark, SMALL).count()
    assert seen.value == real(spark, SMALL).count()


def test_rows_of_a_frequent_value_are_ranked_by_many_tasks(spark, monkeypatch):
    largest = []

    def watched(df, order, name="row_index"):
        out = with_row_index(df, order, name)
        largest.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(resample, "with_row_index", watched)
    monkeypatch.setattr(resample, "DEMAND_MEASURES", ("units_returned", "units_sold"))
    demand = spark.range(0, 8000, 1, 4).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).cast("double").alias("units_returned"), F.col("id").cast("double").alias("units_sold")
    )
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = resample.copula_sample(demand, 500).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) == 500 and largest[0] < 0.9 * 8000, largest
