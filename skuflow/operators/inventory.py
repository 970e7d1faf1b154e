"""Stock levels: reorder scan, stock lines, reorder points and purchase-order values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import filled, half_up, number_text, signed_text


def filter_sku(df: DataFrame, sku_id: str) -> DataFrame:
    return df.where(F.col("sku_id") == sku_id)


def reorder_scan(inventory: DataFrame) -> DataFrame:
    """Rows at or below their reorder point, with the gap."""
    return inventory.where(F.col("total_available") <= F.col("reorder_point")).withColumn(
        "gap", (F.col("total_available") - F.col("reorder_point")).cast("double")
    )


def reorder_severity(gap: Column) -> Column:
    return F.when(gap < fv.REORDER_HIGH_GAP, "high").when(gap < fv.REORDER_MEDIUM_GAP, "medium").otherwise("low")


def reorder_alerts(inventory: DataFrame) -> DataFrame:
    """One alert per SKU at or below its reorder point."""
    message = filled(
        fv.REORDER_MESSAGE, available=number_text(F.col("total_available")), reorder_point=number_text(F.col("reorder_point")),
        status=F.coalesce("status", F.lit("")),
    )
    return reorder_scan(inventory).select(
        "sku_id",
        F.coalesce("item_name", "sku_id").alias("item_name"),
        F.lit("reorder").alias("alert_type"),
        reorder_severity(F.col("gap")).alias("severity"),
        F.col("total_available").cast("double").alias("current_stock"),
        F.col("reorder_point").cast("double").alias("reorder_point"),
        half_up(F.col("gap"), 1).alias("gap"),
        message.alias("message"),
    )


def stock_check(inventory: DataFrame) -> DataFrame:
    """Gap to the reorder point, an alert flag and the stock text of every SKU."""
    gap = F.col("total_available") - F.col("reorder_point")
    needs_order = gap <= 0
    needed, fine = fv.STOCK_VERDICTS
    text = filled(
        fv.STOCK_TEXT, sku=F.col("sku_id"), item=F.col("item_name"), on_hand=F.col("qty_on_hand").cast("string"),
        wip=F.col("qty_wip").cast("string"), in_transit=F.col("qty_in_transit").cast("string"),
        available=F.col("total_available").cast("string"), reorder_point=F.col("reorder_point").cast("string"),
        days=number_text(F.col("days_of_stock"), 1), status=F.col("status"), gap=signed_text(gap),
        verdict=F.when(needs_order, needed).otherwise(fine),
    )
    return inventory.select(
        "sku_id", "item_name", "total_available", "reorder_point",
        gap.cast("double").alias("gap"), needs_order.alias("needs_reorder"), text.alias("stock_text"),
    )


def stock_table(inventory: DataFrame) -> DataFrame:
    """Columns of the stock overview with a level per status text."""
    level = (
        F.when(F.col("status").contains("Critical"), "critical")
        .when(F.col("status").contains("Low"), "low").otherwise("ok")
    )
    return inventory.select(
        "sku_id", "item_name", "qty_on_hand", "total_available", "reorder_point",
        half_up(F.col("total_available") - F.col("reorder_point")).alias("gap_vs_rop"),
        "days_of_stock", "status", level.alias("status_level"),
    )


def po_pricing(orders: DataFrame) -> DataFrame:
    """Subtotal, tax, total and delivery date of purchase orders.

    Needs ``qty``, ``unit_price``, ``po_date``, ``lead_time_days`` and ``offset_days``.
    """
    return (
        orders.withColumn("subtotal", half_up(F.col("qty") * F.col("unit_price"), 2))
        .withColumn("gst", half_up(F.col("subtotal") * fv.GST_RATE, 2))
        .withColumn("total", half_up(F.col("subtotal") + F.col("gst"), 2))
        .withColumn("delivery_date", F.date_add("po_date", (F.col("lead_time_days") + F.col("offset_days")).cast("int")))
    )


def sku_stock_lookup(skus: DataFrame, inventory: DataFrame) -> DataFrame:
    """``skus`` with ``current_available``; 0 where the SKU is not stocked."""
    stock = inventory.select("sku_id", F.col("total_available").cast("double").alias("current_available"))
    return skus.join(stock, "sku_id", "left").withColumn(
        "current_available", F.coalesce("current_available", F.lit(0.0))
    )


def reorder_points(demand_stats: DataFrame, lead_times: DataFrame, inventory: DataFrame) -> DataFrame:
    """Reorder point of every SKU with demand: daily mean × lead time + safety stock.

    ``lead_times`` holds one row per SKU with a known supplier; others take the default.
    """
    joined = sku_stock_lookup(demand_stats.join(lead_times, "sku_id", "left"), inventory)
    return (
        joined.withColumn(
            "lead_time_days", F.coalesce(F.col("lead_time_days").cast("double"), F.lit(fv.DEFAULT_LEAD_TIME_DAYS))
        )
        .withColumn("safety_stock", fv.SERVICE_Z * F.col("std_monthly"))
        .withColumn("rop", F.col("avg_daily") * F.col("lead_time_days") + F.col("safety_stock"))
        .withColumn("reorder_now", F.col("current_available") < F.col("rop"))
        .select("sku_id", "avg_daily", "lead_time_days", "safety_stock", "rop", "current_available", "reorder_now")
    )


def rop_text(rop: DataFrame) -> DataFrame:
    """Text of the reorder-point analysis."""
    now, fine = fv.ROP_VERDICTS
    text = filled(
        fv.ROP_TEXT, sku=F.col("sku_id"), daily=number_text(F.col("avg_daily"), 1),
        lead_time=number_text(F.col("lead_time_days")), safety_stock=number_text(F.col("safety_stock")),
        rop=number_text(F.col("rop")), available=number_text(F.col("current_available")),
        verdict=F.when(F.col("reorder_now"), now).otherwise(fine),
    )
    return rop.select("sku_id", text.alias("rop_text"))


def request_filter(requests: DataFrame, one_sku: bool = True) -> DataFrame:
    """``is_valid`` for requests with ``question`` and ``horizon``."""
    low, high = fv.HORIZON_ONE_SKU if one_sku else fv.HORIZON_ALL_SKUS
    valid = F.length("question").between(*fv.QUESTION_LENGTH) & F.col("horizon").between(low, high)
    return requests.withColumn("is_valid", F.coalesce(valid, F.lit(False)))
