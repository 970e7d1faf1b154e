"""Demand features per SKU, all from one window over (sku_id, period).

A demand table has one row per SKU and month, so a SKU's window holds at most as many rows as there
are months, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import abc_weight, high_season

def _by_sku() -> WindowSpec:
    return Window.partitionBy("sku_id").orderBy("period")


def _prior(rows: int) -> WindowSpec:
    return _by_sku().rowsBetween(-rows, -1)


def lag_units(rows: int) -> Column:
    return F.lag("net_units", rows).over(_by_sku())


def rolling_mean(rows: int) -> Column:
    """Mean of the prior ``rows`` rows; null unless all of them exist."""
    frame = _prior(rows)
    return F.when(F.count("net_units").over(frame) == rows, F.avg("net_units").over(frame))


def rolling_std(rows: int) -> Column:
    """Sample deviation of the prior ``rows`` rows; 0 unless all of them exist."""
    frame = _prior(rows)
    spread = F.when(F.count("net_units").over(frame) == rows, F.stddev_samp("net_units").over(frame))
    return F.coalesce(spread, F.lit(0.0))


def growth(current: Column, earlier: Column) -> Column:
    """Relative change; 0 without an earlier value or for 0 to 0, signed infinity from 0."""
    return (
        F.when(earlier.isNull() | current.isNull(), 0.0)
        .when((earlier == 0) & (current == 0), 0.0)
        .when((earlier == 0) & (current > 0), F.lit(float("inf")))
        .when(earlier == 0, F.lit(float("-inf")))
        .otherwise(F.try_divide(current - earlier, earlier))
    )


def with_lags(demand: DataFrame) -> DataFrame:
    return demand.withColumns({f"lag_{rows}": lag_units(rows) for rows in (1, 3, 6)})


def with_growth(demand: DataFrame) -> DataFrame:
    return demand.withColumn("yoy_growth", growth(F.col("net_units"), lag_units(12)))


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "month": F.month("period"),
            "quarter": F.quarter("period"),
            "is_high_season": high_season(F.month("period")),
        }
    )


def sku_features(demand: DataFrame) -> DataFrame:
    """Feature matrix: rows without a previous month are left out."""
    windowed = demand.where(F.col("sku_id").isNotNull()).withColumns(
        {
            "lag_1": lag_units(1),
            "lag_3": lag_units(3),
            "lag_6": lag_units(6),
            "roll_mean_3": rolling_mean(3),
            "roll_std_3": rolling_std(3),
            "roll_mean_6": rolling_mean(6),
            "yoy_growth": growth(F.col("net_units"), lag_units(12)),
        }
    )
    return with_calendar(windowed).withColumn("abc_enc", abc_weight(F.col("abc_class"))).na.drop(subset=["lag_1"])


def last_rows(df: DataFrame, rows: int) -> DataFrame:
    """The latest ``rows`` rows of every SKU; ``place`` counts back from 1."""
    newest_first = Window.partitionBy("sku_id").orderBy(F.desc("period"))
    return df.withColumn("place", F.row_number().over(newest_first)).where(F.col("place") <= rows)
