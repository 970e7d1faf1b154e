"""Anomalies by z-score, thresholds by contamination, severities and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import filled, half_up, number_text, one_value, with_values
from skuflow.operators.features import sku_features
from skuflow.operators.quantiles import exact_quantiles


def anomaly_features(features: DataFrame) -> DataFrame:
    """Anomaly columns with their SKU, month and name; rows with a missing value are left out."""
    columns = list(fv.ANOMALY_COLUMNS)
    return features.select("sku_id", "period", "product_name", *columns).na.drop(subset=columns)


def _largest_z(mean: dict[str, Column], std: dict[str, Column]) -> Column:
    scores = [F.abs(F.col(c) - mean[c]) / (std[c] + fv.ZSCORE_EPSILON) for c in fv.ANOMALY_COLUMNS]
    return F.greatest(*scores)


def zscore_scores(rows: DataFrame, scope: str = "global") -> DataFrame:
    """``anomaly_score`` = minus the largest z over the anomaly columns, and ``is_anomaly``.

    ``scope`` is ``global`` (statistics of the whole table) or ``per_sku``.
    """
    columns = fv.ANOMALY_COLUMNS
    if scope == "global":
        stats = one_value(
            rows,
            F.struct(
                *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
            ),
        )

        def largest(s: Column) -> Column:
            return _largest_z({c: s[f"{c}_mean"] for c in columns}, {c: s[f"{c}_std"] for c in columns})

        scored = with_values(rows, stats, "z", largest)
    elif scope == "per_sku":
        group = Window.partitionBy("sku_id")
        mean = {c: F.avg(c).over(group) for c in columns}
        std = {c: F.stddev_pop(c).over(group) for c in columns}
        scored = rows.withColumn("z", _largest_z(mean, std))
    else:
        raise ValueError(f"unknown scope: {scope}")
    return (
        scored.withColumn("anomaly_score", -F.col("z"))
        .withColumn("is_anomaly", F.col("z") > fv.ZSCORE_LIMIT).drop("z")
    )


def flagged(scored: DataFrame, sku_id: str | None = None) -> DataFrame:
    """The flagged rows with the columns of an anomaly record."""
    rows = scored.where("is_anomaly")
    if sku_id:
        rows = rows.where(F.col("sku_id") == sku_id)
    return rows.select("sku_id", "product_name", "period", "net_units", "roll_mean_3", "anomaly_score")


def zscore_anomalies(demand: DataFrame, sku_id: str | None = None) -> DataFrame:
    """Flagged months by z-score. For one SKU the statistics are those of its own rows."""
    if sku_id:
        demand = demand.where(F.col("sku_id") == sku_id)
    return flagged(zscore_scores(anomaly_features(sku_features(demand))))


def anomaly_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("row_count"),
        F.count_if("is_anomaly").alias("flagged"),
        (F.avg(F.col("is_anomaly").cast("double")) * 100.0).alias("flagged_pct"),
    )


def contamination_sweep(scored: DataFrame, levels: tuple[float, ...] = fv.CONTAMINATION_LEVELS) -> DataFrame:
    """Flagged rows per contamination level.

    Scores do not depend on the level; only the limit does. The limits are exact percentiles of the
    scores, and one pass counts the rows below each.
    """
    limits = exact_quantiles(scored, "anomaly_score", list(levels))
    counts = scored.agg(
        F.count("*").alias("row_count"),
        F.array(
            *[
                F.struct(F.lit(level).alias("contamination"), F.count_if(F.col("anomaly_score") < limit).alias("flagged"))
                for level, limit in zip(levels, limits)
            ]
        ).alias("levels"),
    )
    return counts.select("row_count", F.inline("levels")).select(
        "contamination", "flagged", half_up(F.col("flagged") * 100.0 / F.col("row_count"), 1).alias("flagged_pct")
    )


def anomaly_severity(score: Column) -> Column:
    return (
        F.when(score < fv.ANOMALY_HIGH_SCORE, "high").when(score < fv.ANOMALY_MEDIUM_SCORE, "medium").otherwise("low")
    )


def first_anomalies(anomalies: DataFrame, count: int) -> DataFrame:
    """The first flagged rows in (sku_id, period) order."""
    return anomalies.orderBy("sku_id", "period").limit(count)


def first_anomalies_per_sku(anomalies: DataFrame, count: int = fv.SKU_ANOMALY_CAP) -> DataFrame:
    by_month = Window.partitionBy("sku_id").orderBy("period")
    return anomalies.withColumn("place", F.row_number().over(by_month)).where(F.col("place") <= count)


def top_anomalies(anomalies: DataFrame, count: int = 10) -> DataFrame:
    """Report of the lowest scores."""
    return anomalies.orderBy("anomaly_score", "sku_id", "period").limit(count)


def month_text(period: Column) -> Column:
    return F.date_format(period, "yyyy-MM")


def anomaly_alerts(anomalies: DataFrame, count: int = fv.ALERT_ANOMALY_CAP) -> DataFrame:
    """Alerts of the first flagged rows."""
    message = filled(
        fv.ANOMALY_MESSAGE, month=month_text(F.col("period")), units=number_text(F.col("net_units")),
        average=number_text(F.col("roll_mean_3")),
    )
    return first_anomalies(anomalies, count).select(
        "sku_id",
        F.substring(F.coalesce("product_name", "sku_id"), 1, 30).alias("item_name"),
        F.lit("anomaly").alias("alert_type"),
        anomaly_severity(F.col("anomaly_score")).alias("severity"),
        half_up(F.col("anomaly_score"), 4).alias("anomaly_score"),
        message.alias("message"),
        "period",
    )
