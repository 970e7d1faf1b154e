"""Stateless operators give the same rows on a stream."""

import pytest
from pyspark.sql import functions as F

from skuflow.operators import documents, intents, inventory
from skuflow.sources import tables
from skuflow.streaming.stateless import run_available, stream_folder
from tests.conftest import SMALL

CASES = {
    "classify_intent": (lambda s: tables.questions(s, SMALL), intents.classify_intent),
    "sku_extract": (
        lambda s: tables.questions(s, SMALL), lambda df: df.select("query_id", intents.sku_extract(F.col("question")).alias("sku"))
    ),
    "clean_text": (lambda s: tables.pages(s, SMALL), documents.clean_pages),
    "doc_type": (lambda s: tables.pages(s, SMALL), lambda df: df.select("source", documents.doc_type(F.col("source")).alias("t"))),
    "reorder_scan": (lambda s: tables.inventory(s, SMALL), inventory.reorder_scan),
    "request_filter": (
        lambda s: tables.questions(s, SMALL).withColumn("horizon", F.length("question") % 14), inventory.request_filter
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, name):
    source, operator = CASES[name]
    rows = source(spark)
    folder, target, state = (str(tmp_path / part) for part in ("in", "out", "state"))
    rows.repartition(4).write.parquet(folder)
    for _ in range(2):
        # The second run finds nothing new.
        run_available(stream_folder(spark, folder, rows.schema, 2), operator, target, state).awaitTermination()
    found = spark.read.parquet(target)
    assert sorted(map(str, found.collect())) == sorted(map(str, operator(rows).select(*found.columns).collect()))
