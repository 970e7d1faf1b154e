"""Consecutive row numbers over a whole table without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from skuflow.session import checkpointed

_ROW_BITS = 33


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """``df`` with 0, 1, 2, … in the given order.

    Rows are range-partitioned and written once, so that partition numbers stay fixed; each row adds
    its place in the partition to the rows of the partitions before it. The driver sees one count per
    partition, and these counts, bounded by the number of partitions, are broadcast.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = checkpointed(placed.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    counts = sorted(map(tuple, fixed.groupBy(part.alias("_part")).count().collect()))
    starts = accumulate((rows for _, rows in counts), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(number, start) for (number, _), start in zip(counts, starts)], "_part long, _offset long"
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside).drop("_place", "_part", "_offset")
    )
