"""Operators without state on streams.

Question routing, text cleaning, document types, reorder scans and request checks keep no state and do
not sort, so the batch functions run on a streaming DataFrame as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def stream_folder(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(
    source: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Apply ``operator`` to all rows that are there and append them to Parquet files, each row once.

    A later call with the same ``checkpoint`` goes on where this one ended.
    """
    return (
        operator(source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(target)
    )
