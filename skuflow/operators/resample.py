"""Data extension: month × SKU grids, bootstrap, Gaussian copula and synthetic purchase orders.

Draws come from hashes of a row number, so results do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skuflow.functions.draws import integer, normal, uniform
from skuflow.functions.scalar import half_up, one_value
from skuflow.operators.inventory import po_pricing
from skuflow.operators.row_index import with_row_index
from skuflow.session import checkpointed

DEMAND_MEASURES = ("units_sold", "units_returned", "net_units", "revenue")


def _months(demand: DataFrame) -> Column:
    """The months from the first to the last of the table, as a scalar subquery."""
    return one_value(demand, F.sequence(F.min("period"), F.max("period"), F.expr("interval 1 month")))


def _first_names(demand: DataFrame) -> DataFrame:
    return demand.groupBy("sku_id").agg(
        F.min_by("product_name", "period").alias("product_name"), F.min_by("abc_class", "period").alias("abc_class")
    )


def month_sku_rows(demand: DataFrame) -> DataFrame:
    """Every SKU with every month from the first to the last of the table.

    Months come from a scalar subquery and a sequence per SKU; no table is crossed with another.
    """
    return _first_names(demand).withColumn("period", F.explode(_months(demand)))


def numbered_grid(demand: DataFrame) -> DataFrame:
    """``month_sku_rows`` with ``row_id``, its place by month and SKU.

    Only the SKUs are sorted; a row's place is its month's number times the SKUs, and its SKU's number.
    """
    skus = with_row_index(_first_names(demand), ["sku_id"], "sku_number")
    every = skus.select("*", F.posexplode(_months(demand)).alias("month_number", "period"))
    place = F.col("month_number").cast("long") * F.lit(skus.count()) + F.col("sku_number")
    return every.withColumn("row_id", place).drop("month_number", "sku_number")


def period_sku_grid(demand: DataFrame) -> DataFrame:
    """Every SKU with every month, measures where known."""
    measures = demand.select("sku_id", "period", "units_sold", "units_returned", "net_units")
    return month_sku_rows(demand).join(measures, ["sku_id", "period"], "left")


def distinct_skus(demand: DataFrame) -> DataFrame:
    return demand.select("sku_id", "product_name", "abc_class").dropDuplicates()


def _sampled(spark: SparkSession, seed_table: DataFrame, order: list[str], rows: int, seed: int) -> DataFrame:
    """``rows`` rows drawn with replacement from ``seed_table``, as row_id and the drawn columns."""
    numbered = with_row_index(seed_table, order)
    total = one_value(seed_table, F.count("*"))
    drawn = spark.range(rows).withColumnRenamed("id", "row_id").withColumn(
        "row_index", F.floor(uniform(seed, F.col("row_id"), "pick") * total)
    )
    return drawn.join(numbered, "row_index").drop("row_index")


def bootstrap_demand(demand: DataFrame, rows: int, seed: int = 42, noise: float = 0.12) -> DataFrame:
    """``rows`` measure rows drawn with replacement, each cell times noise around 1, whole and not negative."""
    measures = demand.select("sku_id", "period", *DEMAND_MEASURES)
    drawn = _sampled(demand.sparkSession, measures, ["sku_id", "period"], rows, seed)
    cells = [
        half_up(F.abs(F.col(name) * normal(seed, F.col("row_id"), name, 1.0, noise))).alias(name)
        for name in DEMAND_MEASURES
    ]
    return drawn.select("row_id", *cells)


def bootstrap_po(orders: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` purchase orders drawn with replacement with noise on quantity and rate, and new numbers."""
    drawn = _sampled(orders.sparkSession, orders, ["po_number"], rows, seed).drop("po_number")
    row = F.col("row_id")
    quantity = half_up(F.greatest(F.col("qty_ordered") * normal(seed, row, "quantity", 1.0, 0.15), F.lit(10.0)))
    rate = half_up(F.col("rate_per_unit") * normal(seed, row, "rate", 1.0, 0.08), 2)
    return (
        drawn.withColumn("qty_ordered", quantity).withColumn("rate_per_unit", rate)
        .withColumn("po_value", half_up(F.col("qty_ordered") * F.col("rate_per_unit"), 2))
        .withColumn("po_number", F.format_string("SYN-PO-%05d", row)).drop("row_id")
    )


def copula_sample(demand: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` measure rows with the margins and rank correlation of the table (Gaussian copula).

    Values are numbered in order by a distributed sort, once per measure, and written; equal values share their mean
    rank, whose normal score is exact. Which of them comes first makes no difference, so rows of a frequent value are
    dealt out to many tasks; the scores of few values are a small table, which Spark sends to the tasks. A drawn share is the value at that share of the ranks, joined by number, so
    the margins are those of the table at every share. The driver sees the 4 × 4 correlation only.
    """
    spark = demand.sparkSession
    names = list(DEMAND_MEASURES)
    complete = demand.select(*[F.col(name).cast("double").alias(name) for name in names]).na.drop()
    total = complete.count()
    if not total:
        return spark.range(0).select(F.col("id").alias("row_id"), *[F.lit(0.0).alias(name) for name in names])
    tied = complete.withColumn("_tie", F.monotonically_increasing_id())
    ranked = {name: with_row_index(tied.select(name, "_tie"), [name, "_tie"], "rank").drop("_tie") for name in names}
    scored = complete
    for name in names:
        share = (F.min("rank") + F.max("rank") + 1) / 2.0 / float(total)
        shares = ranked[name].groupBy(name).agg(share.alias("share"))
        scored = scored.join(checkpointed(shares.select(name, normal_score(F.col("share")).alias(f"score_{name}"))), name)
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    # Nine decimals don't depend on the order of the sums.
    row = scored.agg(*[half_up(F.corr(f"score_{names[i]}", f"score_{names[j]}"), 9).alias(f"c{i}{j}") for i, j in pairs]).first()
    correlation = np.eye(len(names))
    for i, j in pairs:
        value = row[f"c{i}{j}"]
        correlation[i, j] = correlation[j, i] = value if value is not None and math.isfinite(value) else 0.0
    factor = np.linalg.cholesky(_definite(correlation))
    base = spark.range(rows).withColumnRenamed("id", "row_id")
    drawn = base.select("row_id", *[normal(seed, F.col("row_id"), name).alias(f"z{i}") for i, name in enumerate(names)])
    places = []
    for i, name in enumerate(names):
        mixed = sum((F.col(f"z{j}") * float(factor[i, j]) for j in range(i + 1)), F.lit(0.0))
        places.append(F.least(F.floor(_normal_share(mixed) * float(total)), F.lit(total - 1)).alias(f"rank_{name}"))
    drawn = drawn.select("row_id", *places)
    for name in names:
        value = ranked[name].select(F.col("rank").alias(f"rank_{name}"), half_up(F.abs(name)).alias(name))
        drawn = drawn.join(value, f"rank_{name}")
    return drawn.select("row_id", *names)


# Coefficients of Acklam's rational approximation of the inverse normal distribution (error below 2e-9).
NORMAL_MIDDLE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)
NORMAL_TAIL = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)
NORMAL_EDGE = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        total = total * x + coefficient
    return total


def normal_score(share: Column) -> Column:
    """The standard normal value below which a share between 0 and 1 lies."""
    middle, (above, below) = share - 0.5, NORMAL_MIDDLE
    central = _polynomial(above, middle * middle) * middle / _polynomial(below, middle * middle)

    def tail(p: Column) -> Column:
        q = F.sqrt(-2.0 * F.log(p))
        return _polynomial(NORMAL_TAIL[0], q) / _polynomial(NORMAL_TAIL[1], q)

    return F.when(share < NORMAL_EDGE, tail(share)).when(share > 1 - NORMAL_EDGE, -tail(1.0 - share)).otherwise(central)


def _normal_share(value: Column) -> Column:
    """Normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    size = F.abs(value)
    t = 1.0 / (1.0 + 0.2316419 * size)
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-size * size / 2.0) / math.sqrt(2.0 * math.pi) * tail
    return F.when(value >= 0, 1.0 - tail).otherwise(tail)


def _definite(matrix: np.ndarray) -> np.ndarray:
    """The matrix, or the nearest definite one if a combination of the measures is constant."""
    values, vectors = np.linalg.eigh(matrix)
    if values.min() > 1e-9:
        return matrix
    fixed = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def extend_demand(demand: DataFrame, target_rows: int, seed: int = 42, method: str = "bootstrap") -> DataFrame:
    """Month × SKU rows with sampled measures: as many as the grid has, at most ``target_rows``.

    Rows are numbered by month and SKU; row i takes sample i. ``method`` is ``bootstrap`` or ``copula``.
    """
    numbered = numbered_grid(demand).where(F.col("row_id") < target_rows)
    if method == "bootstrap":
        sample = bootstrap_demand(demand, target_rows, seed)
    elif method == "copula":
        sample = copula_sample(demand, target_rows, seed)
    else:
        raise ValueError(f"unknown method: {method}")
    names = demand.select("channel").distinct().agg(F.sort_array(F.collect_list("channel")).alias("names")).scalar()
    pick = F.floor(uniform(seed, F.col("row_id"), "channel") * F.size(names))
    channels = F.get(names, pick.cast("int"))
    return numbered.join(sample.drop("net_units"), "row_id").select(
        F.format_string("SYN-%05d", "row_id").alias("record_id"),
        "period", F.date_format("period", "MMM").alias("month"), F.year("period").alias("year"),
        "sku_id", "product_name", "abc_class", channels.alias("channel"),
        "units_sold", "units_returned",
        F.greatest(F.col("units_sold") - F.col("units_returned"), F.lit(0.0)).alias("net_units"),
        "revenue",
    )


def synthesize_po(offers: DataFrame, rows: int, first_day: str = "2022-01-01", last_day: str = "2025-05-18", seed: int = 42) -> DataFrame:
    """``rows`` random purchase orders over ``offers``, priced.

    ``offers`` has supplier_id, sku_id, lead_time_days, min_order_qty, price_low and price_high; each order
    draws one offer, a day, a quantity of one to four times the minimum and a price in the range.
    """
    drawn = _sampled(offers.sparkSession, offers, ["supplier_id", "sku_id"], rows, seed)
    row = F.col("row_id")
    start, end = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    day = F.date_add(start, integer(seed, row, "day", 0, F.date_diff(end, start)).cast("int"))
    price = half_up(F.col("price_low") + uniform(seed, row, "price") * (F.col("price_high") - F.col("price_low")), 2)
    orders = drawn.select(
        F.format_string("PO-%d-%04d", F.year(day), row + 1).alias("po_number"),
        "supplier_id", "sku_id", day.alias("po_date"),
        F.col("lead_time_days").cast("long").alias("lead_time_days"),
        integer(seed, row, "offset", -5, 10).alias("offset_days"),
        integer(seed, row, "quantity", F.col("min_order_qty"), F.col("min_order_qty") * 4).cast("double").alias("qty"),
        price.alias("unit_price"),
    )
    return po_pricing(orders)
