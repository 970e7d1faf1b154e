"""Routing of questions."""

import pytest
from pyspark.sql import functions as F

from skuflow.operators import intents, inventory

CASES = [
    ("forecast demand for TBP-001 next month", "demand", "TBP-001"),
    ("which SKUs need reordering?", "reorder", ""),
    ("who is the best supplier for RSH-001?", "supplier", "RSH-001"),
    # One demand word and one anomaly word: the first intent wins the tie.
    ("any unusual demand anomalies this month?", "demand", ""),
    ("forecast for TBP-001 please", "demand", "TBP-001"),
    ("which items need reordering?", "reorder", ""),
    ("hello there", "general", ""),
    ("is rm-wr-002 out of stock?", "reorder", "RM-WR-002"),
    ("a spike and an outlier", "anomaly", ""),
]


def test_routing_cases(spark):
    asked = spark.createDataFrame([(text,) for text, _, _ in CASES], "question string")
    rows = {r.question: (r.intent, r.sku_id) for r in intents.classify_intent(asked).collect()}
    assert rows == {text: (intent, sku) for text, intent, sku in CASES}


def test_general_goes_to_demand_with_top_sku(spark):
    asked = intents.classify_intent(spark.createDataFrame([("hello there",), ("need to reorder",)], "question string"))
    routed = {r.question: r for r in intents.route(asked, F.lit("TOP-1")).collect()}
    assert (routed["hello there"].handler, routed["hello there"].target_sku) == ("demand", "TOP-1")
    assert (routed["need to reorder"].handler, routed["need to reorder"].target_sku) == ("reorder", "")


@pytest.mark.parametrize(
    "question, horizon, one, everyone",
    [("ab", 3, False, False), ("abc", 3, True, True), ("x" * 500, 3, True, True), ("x" * 501, 3, False, False),
     ("abc", 15, False, False), ("abc", 12, True, False), ("abc", 0, False, False), (None, 3, False, False)],
)
def test_request_bounds(spark, question, horizon, one, everyone):
    rows = spark.createDataFrame([(question, horizon)], "question string, horizon int")
    assert inventory.request_filter(rows).first().is_valid is one
    assert inventory.request_filter(rows, one_sku=False).first().is_valid is everyone
