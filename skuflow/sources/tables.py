"""Business tables derived from the star-schema Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sku_code(key: Column) -> Column:
    return F.format_string("SKU-%06d", key)


def supplier_code(key: Column) -> Column:
    return F.format_string("SUP-%05d", key)


def _abc_class(key: Column) -> Column:
    return F.when(key % 4 == 0, "A").when(key % 4 == 1, "B").when(key % 4 == 2, "C").otherwise("—")


def demand_history(spark: SparkSession, folder: str) -> DataFrame:
    """One row per SKU and month with sales.

    The fact table is aggregated before it meets ``part``, and they meet on the SKU code, so that windows
    and aggregates per SKU find their rows together already.
    """
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    kept_share = F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey", F.date_trunc("month", "l_shipdate").cast("date").alias("period"))
        .agg(
            F.min("l_linestatus").alias("channel"),
            F.sum("l_quantity").alias("units_sold"),
            F.sum(returned).alias("units_returned"),
            F.sum(price * kept_share).cast("double").alias("revenue"),
        )
        .withColumn("sku_id", sku_code(F.col("l_partkey")))
    )
    part = table(spark, folder, "part").select(
        sku_code(F.col("p_partkey")).alias("sku_id"),
        F.col("p_name").alias("product_name"),
        _abc_class(F.col("p_partkey")).alias("abc_class"),
    )
    return monthly.join(part, "sku_id").select(
        "sku_id", "period", "product_name", "abc_class", "channel", "units_sold", "units_returned",
        F.greatest(F.col("units_sold") - F.col("units_returned"), F.lit(0.0)).alias("net_units"),
        "revenue",
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    base = table(spark, folder, "part").select(
        sku_code(key).alias("sku_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_type"),
        _abc_class(key).alias("abc_class"),
        (F.col("p_size") * 8).cast("long").alias("qty_on_hand"),
        ((key * 7) % 40).alias("qty_wip"),
        ((key * 13) % 25).alias("qty_in_transit"),
        (60 + (key * 31) % 200).alias("reorder_point"),
        (1 + F.col("p_size") % 7).cast("double").alias("daily_use"),
    )
    total = F.col("qty_on_hand") + F.col("qty_wip") + F.col("qty_in_transit")
    return base.withColumn("total_available", total).select(
        "sku_id", "item_name", "item_type", "abc_class", "qty_on_hand", "qty_wip", "qty_in_transit",
        "total_available", "reorder_point",
        (F.floor(F.col("total_available") / F.col("daily_use") * 10 + 0.5) / F.lit(10.0)).alias("days_of_stock"),
        F.when(F.col("total_available") * 2 <= F.col("reorder_point"), "Critical")
        .when(F.col("total_available") <= F.col("reorder_point"), "Low")
        .otherwise("OK").alias("status"),
    )


def supplier_directory(spark: SparkSession, folder: str) -> DataFrame:
    """All suppliers, under numbers moved by 2, so that some are in the terms only and some here only."""
    key = F.col("s_suppkey")
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            supplier_code(key + 2).alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            (70 + (key * 7) % 27).cast("double").alias("on_time_rate_pct"),
            F.when(key % 4 == 0, "15 days net").when(key % 4 == 1, "30 days net")
            .when(key % 4 == 2, "45 days net").otherwise("60 days net").alias("payment_terms"),
        )
    )


def supplier_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of all suppliers, under numbers moved by 1: one supplier sells without terms, one has terms and sells nothing."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        supplier_code(key + 1).alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        (15 + key % 53).alias("lead_time_days"),
        (100 + (key * 37) % 350).alias("min_order_qty"),
        (70 + (key * 7) % 27).cast("double").alias("on_time_rate_pct"),
        (10 * (key % 4)).alias("advance_pct"),
    )


def supplier_sku(spark: SparkSession, folder: str) -> DataFrame:
    """Which supplier sells which SKU. SKU numbers are moved by 50, so that some SKUs have no supplier."""
    return _sold(spark, folder).select(
        supplier_code(F.col("l_suppkey")).alias("supplier_id"), sku_code(F.col("number")).alias("sku_id")
    )


def _sold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_partkey") + 50).alias("number")).distinct()


def supplier_sku_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The same as delimited lists: a supplier has one list per 50 neighbouring SKU numbers, so none grows long."""
    code = sku_code(F.col("number"))
    return (
        _sold(spark, folder).groupBy("l_suppkey", F.floor(F.col("number") / 50).alias("list_no"))
        .agg(F.array_join(F.sort_array(F.collect_list(code)), "; ").alias("skus_supplied"))
        .select(supplier_code(F.col("l_suppkey")).alias("supplier_id"), "list_no", "skus_supplied")
    )


def purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("po_date"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    number = F.concat_ws("-", F.lit("PO"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        number.alias("po_number"),
        "po_date",
        supplier_code(F.col("l_suppkey")).alias("supplier_id"),
        sku_code(F.col("l_partkey")).alias("sku_id"),
        F.col("l_quantity").alias("qty_ordered"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / F.lit(100.0)).alias("rate_per_unit"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    prefix = (
        F.when(key % 4 == 0, "PO_").when(key % 4 == 1, "catalog_")
        .when(key % 4 == 2, "Purchase_note_").otherwise("misc_")
    )
    return table(spark, folder, "documents").select(
        F.concat(prefix, F.format_string("%06d", key), F.lit(".pdf")).alias("source"),
        F.lit(0).alias("page"),
        "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of the conversations, one question per row."""
    return (
        table(spark, folder, "conversations").where(F.col("role") == "user")
        .select(F.format_string("Q%08d-%04d", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))
    )
