"""Alert board: reorder and anomaly alerts, ordered, with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skuflow.functions.scalar import severity_rank
from skuflow.operators.anomaly import anomaly_alerts
from skuflow.operators.inventory import reorder_alerts


def union_alerts(inventory: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Both kinds of alerts with one set of columns."""
    return reorder_alerts(inventory).unionByName(anomaly_alerts(anomalies), allowMissingColumns=True)


def alerts(inventory: DataFrame, anomalies: DataFrame) -> DataFrame:
    """All alerts: high severity first, reorder before anomaly, then SKU and month."""
    type_rank = F.when(F.col("alert_type") == "reorder", 0).otherwise(1)
    return union_alerts(inventory, anomalies).orderBy(severity_rank(F.col("severity")), type_rank, "sku_id", "period")


def alert_counts(all_alerts: DataFrame) -> DataFrame:
    return all_alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(F.col("alert_type") == "reorder").alias("reorder_alerts"),
        F.count_if(F.col("alert_type") == "anomaly").alias("anomaly_alerts"),
    )
