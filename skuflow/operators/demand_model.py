"""Gradient-boosted demand model: training, evaluation, recursive forecast, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import abc_weight, half_up, high_season
from skuflow.operators import boosting
from skuflow.operators.features import growth, last_rows, sku_features
from skuflow.operators.forecast import (
    MODEL_LABEL, clipped, cv_folds, cv_folds_by_row, forecast_bands, forecast_fallback, holdout_split,
)
from skuflow.operators.profile import mape, rmse
from skuflow.session import checkpointed, path_exists

TREES = 300
KEY = ["sku_id", "period"]
_COLUMNS = list(fv.FEATURE_COLUMNS)


def _settings(trees: int, seed: int) -> boosting.Settings:
    return boosting.Settings(trees=trees, rate=0.05, depth=5, rows_share=0.8, columns_share=0.8, seed=seed)


def train(features: DataFrame, trees: int = TREES, seed: int = 42) -> DataFrame:
    """The node table of one model for all SKUs. Missing and infinite features are kept as they are."""
    return boosting.fit(features, KEY, "net_units", _COLUMNS, settings=_settings(trees, seed))


def scorer(model: DataFrame) -> boosting.Scorer:
    return boosting.Scorer.of(model, _COLUMNS)


def predict(model: DataFrame | boosting.Scorer, features: DataFrame) -> DataFrame:
    """``features`` with ``prediction``, not below 0."""
    return _raw_predictions(model, features).withColumn("prediction", clipped(F.col("prediction")))


def _raw_predictions(model: DataFrame | boosting.Scorer, features: DataFrame, number: Column | None = None) -> DataFrame:
    return boosting.predict(scorer(model) if isinstance(model, DataFrame) else model, features, _COLUMNS, number)


def train_folds(features: DataFrame, trees: int = TREES, folds: int = 3, by: str = "period", seed: int = 42, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The models of every expanding fold, all from the same passes, and the fold scores as in ``cv_train``.

    Fold n is model n; with ``whole``, model 0 is that of all rows, trained in the same passes.
    """
    if by not in ("period", "row"):
        raise ValueError(f"unknown split: {by}")
    split = checkpointed(cv_folds(features, folds) if by == "period" else cv_folds_by_row(features, folds))
    rows = split.where(F.col("part") == "train").select("fold", *KEY, "net_units", *_COLUMNS)
    if whole:
        rows = rows.unionByName(features.select(F.lit(0).alias("fold"), *KEY, "net_units", *_COLUMNS))
    models = boosting.fit(rows, KEY, "net_units", _COLUMNS, F.col("fold"), _settings(trees, seed))
    tested = _raw_predictions(models, split.where(F.col("part") == "test"), F.col("fold"))
    actual, predicted = F.col("net_units"), F.col("prediction")
    scores = checkpointed(tested.groupBy("fold").agg(
        F.count("*").alias("row_count"), rmse(actual, predicted).alias("rmse"), mape(actual, predicted).alias("mape")
    ))
    mean = scores.agg(
        F.sum("row_count").alias("row_count"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape")
    ).withColumn("fold", F.lit(0))
    return models, scores.unionByName(mean).select("fold", "row_count", "rmse", "mape")


def cv_train(features: DataFrame, trees: int = TREES, folds: int = 3, by: str = "period", seed: int = 42) -> DataFrame:
    """Row count, RMSE and MAPE of every expanding fold, and their mean as fold 0."""
    return train_folds(features, trees, folds, by, seed)[1]


def holdout_predictions(features: DataFrame, months: int = 3, trees: int = TREES, seed: int = 42) -> DataFrame:
    """Predictions for the last ``months`` months from a model of the months before."""
    split = holdout_split(features, months)
    model = train(split.where(F.col("part") == "train"), trees, seed=seed)
    return _raw_predictions(model, split.where(F.col("part") == "test"))


def feature_importance(model: DataFrame) -> list[tuple[str, float]]:
    """(feature, importance), highest first; the list is as long as the fixed feature list."""
    return boosting.importances(model, _COLUMNS)


def forecast_model(
    model: DataFrame, demand: DataFrame, horizon: int = 3, roll: str = "lag1"
) -> DataFrame:
    """Recursive forecast of every SKU, one row per month ahead.

    Starts from a SKU's last feature row. ``roll="lag1"`` replaces only ``lag_1`` by each prediction;
    ``roll="full"`` starts at the month after the last and moves all lags, means and calendar columns.
    A SKU with a single month has no feature row and takes the rolling-mean forecast.
    """
    if roll not in ("lag1", "full"):
        raise ValueError(f"unknown roll: {roll}")
    low, high = fv.HORIZON_ONE_SKU
    if not low <= horizon <= high:
        raise ValueError(f"horizon must be {low} to {high}")
    spread = demand.groupBy("sku_id").agg(F.stddev_pop("net_units").alias("std"))
    model = scorer(model)
    if roll == "lag1":
        state = _last_features(demand).join(spread, "sku_id")
        points = _roll_lag1(model, state, horizon)
    else:
        points = _roll_full(model, demand, spread, horizon)
    rounded = points.withColumn("raw", F.col("point")).withColumn("forecast", half_up(F.col("point"), 1))
    modelled = forecast_bands(rounded, "raw", "std").select(
        "sku_id", "month_offset", "forecast", "lower_ci", "upper_ci", F.lit(MODEL_LABEL).alias("model")
    )
    single = demand.groupBy("sku_id").agg(F.count("*").alias("months")).where(F.col("months") == 1).select("sku_id")
    return modelled.unionByName(forecast_fallback(demand.join(single, "sku_id", "left_semi"), horizon))


def _last_features(demand: DataFrame) -> DataFrame:
    features = sku_features(demand).select("sku_id", "period", *fv.FEATURE_COLUMNS)
    others = [name for name in features.columns if name != "sku_id"]
    last = features.groupBy("sku_id").agg(F.max_by(F.struct(*others), "period").alias("last"))
    return last.select("sku_id", "last.*")


def _long(state: DataFrame, horizon: int) -> DataFrame:
    points = F.array(*[F.struct(F.lit(m).alias("month_offset"), F.col(f"point_{m}").alias("point")) for m in range(1, horizon + 1)])
    return state.select("sku_id", "std", F.inline(points))


def _roll_lag1(model: boosting.Scorer, state: DataFrame, horizon: int) -> DataFrame:
    for month in range(1, horizon + 1):
        state = predict(model, state).withColumn(f"point_{month}", F.col("prediction"))
        state = state.withColumn("lag_1", F.col("prediction")).drop("prediction")
    return _long(state, horizon)


def _total(months: int, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum over the newest ``months`` values of ``history``."""
    return F.aggregate(F.slice("history", 1, months), F.lit(0.0), lambda total, x: total + of(x))


def _roll_full(model: boosting.Scorer, demand: DataFrame, spread: DataFrame, horizon: int) -> DataFrame:
    # The newest 13 values of a SKU are all that its features look back on.
    recent = last_rows(demand.select("sku_id", "period", "net_units", "abc_class"), 13)
    state = recent.groupBy("sku_id").agg(
        F.max("period").alias("last_period"),
        abc_weight(F.max_by("abc_class", "period")).alias("abc_enc"),
        F.sort_array(F.collect_list(F.struct("place", "net_units")))["net_units"].alias("history"),
    ).where(F.size("history") > 1).join(spread, "sku_id")
    for month in range(1, horizon + 1):
        period = F.add_months("last_period", month)
        deviation = F.sqrt(_total(3, lambda x: (x - _total(3) / 3) * (x - _total(3) / 3)) / 2.0)
        state = state.withColumns(
            {
                "lag_1": F.get("history", F.lit(0)),
                "lag_3": F.get("history", F.lit(2)),
                "lag_6": F.get("history", F.lit(5)),
                "roll_mean_3": F.when(F.size("history") >= 3, _total(3) / 3),
                "roll_std_3": F.when(F.size("history") >= 3, deviation).otherwise(0.0),
                "roll_mean_6": F.when(F.size("history") >= 6, _total(6) / 6),
                # The growth of the month to be forecast is unknown; the last known one stands in.
                "yoy_growth": growth(F.get("history", F.lit(0)), F.get("history", F.lit(12))),
                "month": F.month(period),
                "quarter": F.quarter(period),
                "is_high_season": high_season(F.month(period)),
            }
        )
        state = predict(model, state).withColumn(f"point_{month}", F.col("prediction"))
        state = state.withColumn("history", F.slice(F.concat(F.array("prediction"), "history"), 1, 13))
        state = state.drop("prediction")
    return _long(state, horizon)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(path: str, spark: SparkSession) -> DataFrame | None:
    """The saved model, or ``None`` when nothing is stored at the path; a damaged model is an error."""
    return spark.read.schema(boosting.NODE_SCHEMA).parquet(path) if path_exists(path) else None
