"""Forecasts without a trained model, interval arithmetic, splits and baseline evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import filled, half_up, number_text, one_value
from skuflow.operators.features import rolling_mean
from skuflow.operators.profile import mape, recent_stats, rmse
from skuflow.operators.row_index import with_row_index

ROLLING_MEAN_LABEL = "Rolling Mean (fallback)"
MODEL_LABEL = "Gradient Boosting"


def lower_band(point: Column, std: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), point - fv.SERVICE_Z * std), 1)


def upper_band(point: Column, std: Column) -> Column:
    return half_up(point + fv.SERVICE_Z * std, 1)


def forecast_bands(points: DataFrame, point: str, std: str) -> DataFrame:
    """Lower and upper band of a point forecast with a given deviation."""
    return points.withColumns(
        {"lower_ci": lower_band(F.col(point), F.col(std)), "upper_ci": upper_band(F.col(point), F.col(std))}
    )


def forecast_fallback(demand: DataFrame, horizon: int = 3) -> DataFrame:
    """Flat forecast of every SKU: one row per month ahead.

    The mean of the last three months, with a band from the deviation of the last six.
    """
    flat = recent_stats(demand).withColumn("forecast", half_up(F.col("mean_3"), 1))
    banded = forecast_bands(flat, "forecast", "std_6")
    return banded.select(
        "sku_id",
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("month_offset"),
        "forecast", "lower_ci", "upper_ci",
        F.lit(ROLLING_MEAN_LABEL).alias("model"),
    )


def points_from_arrays(forecasts: DataFrame) -> DataFrame:
    """One row per month ahead from the arrays ``forecast``, ``lower`` and ``upper`` of each SKU."""
    zipped = F.posexplode(F.arrays_zip("forecast", "lower", "upper"))
    return forecasts.select("sku_id", "model", zipped.alias("place", "point")).select(
        "sku_id",
        (F.col("place") + 1).alias("month_offset"),
        F.col("point.forecast").alias("forecast"),
        F.col("point.lower").alias("lower_ci"),
        F.col("point.upper").alias("upper_ci"),
        "model",
    )


def arrays_from_points(points: DataFrame) -> DataFrame:
    """One row per SKU with its horizon and the arrays ``forecast``, ``lower`` and ``upper``."""
    ordered = F.sort_array(F.collect_list(F.struct("month_offset", "forecast", "lower_ci", "upper_ci")))
    return points.groupBy("sku_id", "model").agg(ordered.alias("points")).select(
        "sku_id", "model", F.size("points").alias("horizon"),
        F.col("points.forecast").alias("forecast"),
        F.col("points.lower_ci").alias("lower"),
        F.col("points.upper_ci").alias("upper"),
    )


def forecast_text(points: DataFrame, horizon: int = 3) -> DataFrame:
    """Forecast text of each SKU from its points."""
    line = filled(
        fv.FORECAST_LINE, month=F.col("month_offset").cast("string"), forecast=number_text(F.col("forecast")),
        lower=number_text(F.col("lower_ci")), upper=number_text(F.col("upper_ci")),
    )
    lines = points.groupBy("sku_id").agg(
        F.sort_array(F.collect_list(F.struct("month_offset", line.alias("line")))).alias("lines")
    )
    text = filled(
        fv.FORECAST_HEAD, sku=F.col("sku_id"), horizon=F.lit(str(horizon)), lines=F.array_join("lines.line", "\n")
    )
    return lines.select("sku_id", text.alias("forecast_text"))


def holdout_split(features: DataFrame, months: int = 3) -> DataFrame:
    """``part`` = train or test; the test part is the last ``months`` months of the table."""
    cutoff = F.add_months(one_value(features, F.max("period")), -months)
    return features.withColumn("part", F.when(F.col("period") <= cutoff, "train").otherwise("test"))


def cv_folds(features: DataFrame, folds: int = 3) -> DataFrame:
    """Expanding folds over distinct months: one row per (fold, row), with ``part`` train or test.

    A fold's test slice has ``n // (folds + 1)`` months and its training part is all months before it.
    """
    months = features.select("period").distinct()
    # Windows over the distinct months only: they see one row per month of history.
    ranked = months.select(
        "period",
        (F.dense_rank().over(Window.orderBy("period")) - 1).alias("month_index"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("months"),
    )
    plan = ranked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    size = F.floor(F.col("months") / (folds + 1))
    start = F.col("months") - (F.lit(folds + 1) - F.col("fold")) * size
    part = (
        F.when(F.col("month_index") < start, "train")
        .when(F.col("month_index") < start + size, "test")
    )
    plan = plan.withColumn("part", part).where(F.col("part").isNotNull()).select("period", "fold", "part")
    return features.join(plan, "period")


def cv_folds_by_row(features: DataFrame, folds: int = 3) -> DataFrame:
    """The same folds cut over rows ordered by (sku_id, period) instead of months."""
    numbered = with_row_index(features, ["sku_id", "period"])
    total = one_value(features, F.count("*"))
    size = F.floor(total / (folds + 1))
    start = total - (F.lit(folds + 1) - F.col("fold")) * size
    part = F.when(F.col("row_index") < start, "train").when(F.col("row_index") < start + size, "test")
    return (
        numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("part", part).where(F.col("part").isNotNull()).drop("row_index")
    )


def naive_predictions(demand: DataFrame, months: int = 3) -> DataFrame:
    """Rolling three-month mean as prediction for the last ``months`` months."""
    predicted = demand.withColumn("prediction", rolling_mean(3))
    return holdout_split(predicted, months).where((F.col("part") == "test") & F.col("prediction").isNotNull())


def evaluate(predictions: DataFrame) -> DataFrame:
    """Row count, RMSE and MAPE of ``prediction`` against ``net_units``."""
    actual, predicted = F.col("net_units"), F.col("prediction")
    return predictions.agg(
        F.count("*").alias("row_count"),
        rmse(actual, predicted).alias("rmse"),
        mape(actual, predicted).alias("mape"),
    )


def clipped(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))
