"""Aggregates over demand and data-quality counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import one_value, with_values
from skuflow.operators.features import last_rows


def sku_summary(demand: DataFrame) -> DataFrame:
    return demand.where(F.col("sku_id").isNotNull()).groupBy("sku_id").agg(
        F.sum("net_units").alias("total_units"),
        F.avg("net_units").alias("avg_monthly"),
        F.stddev_samp("net_units").alias("std_dev"),
        F.count("period").alias("periods"),
    )


def abc_units(demand: DataFrame) -> DataFrame:
    return demand.groupBy("sku_id", "abc_class").agg(F.sum("net_units").alias("net_units"))


def abc_counts(demand: DataFrame) -> DataFrame:
    """SKUs per class; a SKU counts with the class of its first month."""
    first = demand.groupBy("sku_id").agg(F.min_by("abc_class", "period").alias("abc_class"))
    return first.groupBy("abc_class").agg(F.count("*").alias("sku_count"))


def sku_demand_stats(demand: DataFrame) -> DataFrame:
    """Mean per month and day, population deviation."""
    return demand.where(F.col("sku_id").isNotNull()).groupBy("sku_id").agg(
        F.avg("net_units").alias("avg_monthly"),
        (F.avg("net_units") / fv.DAYS_PER_MONTH).alias("avg_daily"),
        F.stddev_pop("net_units").alias("std_monthly"),
    )


def recent_stats(demand: DataFrame) -> DataFrame:
    """Mean of the last 3 and population deviation of the last 6 months of every SKU."""
    recent = last_rows(demand.select("sku_id", "period", "net_units"), 6)
    return recent.groupBy("sku_id").agg(
        F.avg(F.when(F.col("place") <= 3, F.col("net_units"))).alias("mean_3"),
        F.stddev_pop("net_units").alias("std_6"),
    )


def top_sku(demand: DataFrame) -> DataFrame:
    """The SKU with the highest mean; the lowest id wins a tie."""
    means = demand.groupBy("sku_id").agg(F.avg("net_units").alias("avg_units"))
    return means.orderBy(F.desc("avg_units"), "sku_id").limit(1)


def of_top_sku(df: DataFrame, demand: DataFrame) -> DataFrame:
    """Rows of ``df`` that belong to the top SKU of ``demand``."""
    return df.where(F.col("sku_id") == top_sku(demand).select("sku_id").scalar())


def top_series(demand: DataFrame, count: int = 5) -> DataFrame:
    """Series of the SKUs with the highest totals."""
    totals = demand.groupBy("sku_id").agg(F.sum("net_units").alias("total_units"))
    leaders = totals.orderBy(F.desc("total_units"), "sku_id").limit(count).select("sku_id")
    return demand.join(leaders, "sku_id", "left_semi")


def distinct_counts(demand: DataFrame) -> DataFrame:
    """Number of SKUs and channels, by distinct groups so that no task holds a set of all keys."""
    named = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("value")) for name in ("sku_id", "channel")])
    return (
        demand.select(F.inline(named)).where(F.col("value").isNotNull()).distinct()
        .groupBy("column").agg(F.count("*").alias("distinct_values"))
    )


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, missing cells and their share of all cells, one row per table."""
    return reduce(DataFrame.unionByName, [_null_row(name, df) for name, df in tables.items()])


def _null_row(name: str, df: DataFrame) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    cells = F.col("row_count") * len(df.columns)
    return df.agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells")
    ).select(
        F.lit(name).alias("table_name"), "row_count", "missing_cells",
        (F.col("missing_cells") * 100.0 / cells).alias("missing_pct"),
    )


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error; a zero actual counts with the smallest divisor of a double."""
    return F.avg(F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(2.220446049250313e-16))) * 100.0


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_z`` = (x − mean) / population deviation; a constant column is divided by 1."""
    stats = one_value(
        df,
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        ),
    )

    def scaled(name: str, s: Column) -> Column:
        spread = s[f"{name}_std"]
        return ((F.col(name) - s[f"{name}_mean"]) / F.when(spread == 0, 1.0).otherwise(spread)).alias(f"{name}_z")

    rows = with_values(df, stats, "_z", lambda s: F.struct(*[scaled(name, s) for name in columns]))
    return rows.select(*df.columns, "_z.*")


def histogram(df: DataFrame, value: str, flag: str, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value, split by ``flag``."""
    limits = one_value(df, F.struct(F.min(value).alias("low"), F.max(value).alias("high")))

    def bin_of(s: Column) -> Column:
        width = (s["high"] - s["low"]) / F.lit(float(bins))
        return F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - s["low"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))

    return with_values(df, limits, "bin", bin_of).groupBy(F.col("bin").cast("int").alias("bin"), flag).agg(F.count("*").alias("row_count"))


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Ascending rank of ``value`` inside ``group``; equal values share their mean rank.

    Counts per distinct value come first, so the window sees one row per (group, value) however many
    rows a group holds.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("equal"))
    before = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        group, value, (F.coalesce(F.sum("equal").over(before), F.lit(0)) + (F.col("equal") + 1) / 2.0).alias(name)
    )
    return df.join(ranks, [group, value])
