"""Plans: pushed filters, pruned columns, no crossed tables, one shuffle per feature table."""

import re

import pytest

from skuflow.operators import features, inventory
from skuflow.plans.queries import QUERIES
from skuflow.sources import tables
from tests.conftest import SMALL

JOINING = [
    "rop", "supplier_recommend", "supplier_profile", "sku_status_default", "period_sku_grid", "zscore_anomaly", "alerts",
    "semi_join_topk", "cv_folds", "holdout_split", "actual_vs_pred", "answer_queries", "chunk_upsert", "po_pricing",
]


@pytest.fixture(autouse=True)
def uncached(spark):
    """Other tests cache the demand table; its plan is looked at without that."""
    spark.catalog.clearCache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_crossed_tables(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sku_filter_reaches_below_the_window(spark):
    text = plan_of(inventory.filter_sku(features.sku_features(tables.demand_history(spark, SMALL)), "SKU-000001"))
    window = text.index("Window [")
    assert "SKU-000001" in text[window:]


def test_reorder_alerts_read_only_needed_columns_and_do_not_shuffle(spark):
    text = plan_of(QUERIES["reorder_alerts"](spark, SMALL))
    assert "Exchange" not in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>", text)


def test_features_share_one_window_shuffle(spark):
    demand = tables.demand_history(spark, SMALL)
    before = plan_of(demand).count("Exchange hashpartitioning")
    assert plan_of(features.sku_features(demand)).count("Exchange hashpartitioning") == before + 1


def test_features_add_no_shuffle_to_a_shuffled_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        demand = tables.demand_history(spark, SMALL)
        before = plan_of(demand).count("Exchange hashpartitioning")
        assert plan_of(features.sku_features(demand)).count("Exchange hashpartitioning") == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
