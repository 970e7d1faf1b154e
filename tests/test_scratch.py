"""Scratch tables and shared results."""

from skuflow.plans import shared
from skuflow.session import checkpointed, drop_scratch, path_exists, scratch_mark


def test_scratch_tables_are_removed(spark):
    mark = scratch_mark(spark)
    tables = [checkpointed(spark.range(10)) for _ in range(3)]
    paths = [t.inputFiles()[0].rsplit("/", 1)[0] for t in tables]
    assert all(path_exists(p) for p in paths)
    assert drop_scratch(spark, mark) == 3
    assert not any(path_exists(p) for p in paths) and scratch_mark(spark) == mark


def test_shared_results_are_made_once(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert shared.stored(spark, "folder", "numbers", build).count() == 5
    assert len(made) == 1
