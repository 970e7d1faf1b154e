"""The registered queries: one per operator, over the whole Parquet tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import abc_weight, half_up, high_season, number_text, signed_text
from skuflow.operators import anomaly, demand_model, documents, features, forecast, intents, inventory, isolation_forest
from skuflow.operators import arima, near_duplicates, nearest_index, profile, resample, retrieval, suppliers
from skuflow.plans import alerts as board, answers, ingest as ingestion, shared, training
from skuflow.session import checkpointed, scratch_path
from skuflow.sources import readers, sinks, tables as src

Query = Callable[[SparkSession, str], DataFrame]
SKU_IN_TEXT = r"\bSKU-\d+\b"

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


def shown(df: DataFrame, *columns: str, **digits: int) -> DataFrame:
    """Columns as results are compared: dates as text, named doubles rounded half up."""
    names = columns or tuple(df.columns)
    kinds = dict(df.dtypes)
    out = []
    for name in names:
        column = F.col(name)
        if name in digits:
            column = half_up(column, digits[name])
        elif kinds[name] in ("date", "timestamp", "timestamp_ntz"):
            column = column.cast("date").cast("string")
        out.append(column.alias(name))
    return df.select(*out)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return features.sku_features(src.demand_history(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.zscore_scores(anomaly.anomaly_features(_features(spark, folder)))


def _rounded_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).withColumn("anomaly_score", half_up(F.col("anomaly_score"), 6))


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.flagged(_scored(spark, folder))


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.suppliers_of_skus(src.supplier_sku(spark, folder), src.supplier_terms(spark, folder))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ingestion.chunks_of(src.pages(spark, folder))


def _csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    sinks.save_csv(df, path)
    return path


# Sources and sinks


@query
def q_scan_demand(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.demand_history(spark, folder).withColumn("period", F.date_format("period", "yyyy-MM"))
    path = _csv(spark, rows.withColumnRenamed("revenue", "revenue_inr"), "demand")
    return shown(readers.read_demand(spark, path), revenue_inr=2)


@query
def q_scan_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return shown(readers.read_inventory(spark, _csv(spark, src.inventory(spark, folder), "inventory")))


@query
def q_scan_supplier_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms with their delimited SKU text, written, read and split into one row per SKU."""
    lists = src.supplier_sku_lists(spark, folder).drop("list_no")
    rows = src.supplier_terms(spark, folder).join(lists, "supplier_id", "left")
    read = readers.read_supplier_terms(spark, _csv(spark, rows, "terms"))
    return read.select("supplier_id", "lead_time_days", "min_order_qty", F.explode_outer("sku_list").alias("sku_id"))


@query
def q_scan_supplier_directory(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_supplier_directory(spark, _csv(spark, src.supplier_directory(spark, folder), "directory"))


@query
def q_scan_purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.purchase_orders(spark, folder).withColumnRenamed("rate_per_unit", "rate_per_unit_inr")
    return shown(readers.read_purchase_orders(spark, _csv(spark, rows, "orders")))


@query
def q_scan_sales_invoices(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.table(spark, folder, "orders").select(
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("invoice_date"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_inr"),
    )
    return shown(readers.read_sales_invoices(spark, _csv(spark, rows, "invoices")))


def _binders(spark: SparkSession, folder: str) -> DataFrame:
    """The pages bound into files of up to forty neighbouring numbers; bytes that are no UTF-8 spoil every 97th page."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    binder = F.concat(F.regexp_extract("source", r"^(\D+)", 1), F.format_string("%05d", F.floor(number / 40)), F.lit(".txt"))
    whole = F.translate("text", "\f", " ")
    spoiled = F.when(number % 97 == 0, F.concat(F.coalesce(whole, F.lit("")).cast("binary"), F.unhex(F.lit("FFFE"))).cast("string"))
    return src.pages(spark, folder).select(binder.alias("source"), number.alias("page"), F.coalesce(spoiled, whole).alias("text"))


@query
def q_scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The pages written as a folder of files and read back; a file that can't be read is one rejected row."""
    path = scratch_path(spark, "documents")
    sinks.save_documents(_binders(spark, folder), path)
    read = readers.read_pages(spark, path, nested=True)
    rows = documents.clean_pages(read, also=F.col("reason").isNotNull())
    return rows.select("source", "page", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "reason")


@query
def q_explode_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogs of up to 50 neighbouring SKUs of a supplier, nested and exploded."""
    part = src.table(spark, folder, "part")
    products = (
        src.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            src.supplier_code(F.col("l_suppkey")).alias("supplier_id"),
            F.floor(F.col("l_partkey") / 50).alias("catalog_no"),
            F.struct(
                src.sku_code(F.col("l_partkey")).alias("sku"), F.col("p_name").alias("name"),
                (F.col("p_size") * 10).alias("moq"), F.col("p_retailprice").alias("price"), F.lit("Pcs").alias("unit"),
            ).alias("product"),
        )
    )
    catalogs = products.groupBy("supplier_id", "catalog_no").agg(F.collect_list("product").alias("products"))
    return readers.explode_catalog(catalogs)


@query
def q_sink_features(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "features")
    sinks.save_features(_features(spark, folder), path)
    stored = sinks.load_features(spark, path)
    return shown(stored, "sku_id", "period", "year", "net_units", "lag_1", "roll_mean_3", "abc_enc", roll_mean_3=4)


@query
def q_sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    demand = _written_demand(spark, folder)
    extended = resample.extend_demand(demand, _sample_rows(demand)).withColumn("period", F.date_format("period", "yyyy-MM"))
    path = _csv(spark, extended.withColumnRenamed("revenue", "revenue_inr"), "extended")
    return shown(readers.read_demand(spark, path))


@query
def q_sink_model(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "forest")
    isolation_forest.save_forest(_forest(spark, folder), path)
    nodes = isolation_forest.load_forest(spark, path)
    return nodes.groupBy("tree").agg(
        F.count("*").alias("node_count"), F.max("depth").alias("depth"), F.max("row_count").alias("row_count")
    )


@query
def q_sink_metrics(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    scores = forecast.evaluate(forecast.naive_predictions(src.demand_history(spark, folder))).first()
    sinks.log_run(spark, path, "naive", {"months": 3}, {"rmse": scores["rmse"], "mape": scores["mape"]})
    stored = spark.read.parquet(path)
    return stored.select("run", F.col("params")["months"].alias("months"), half_up(F.col("metrics")["rmse"], 4).alias("rmse"))


@query
def q_chunk_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents, then labelled documents again with new text."""
    pages = src.pages(spark, folder)
    labelled = src.table(spark, folder, "labels").select("doc_id").distinct()
    again = pages.join(
        labelled.select(F.format_string("%06d.pdf", "doc_id").alias("number")),
        F.substring_index("source", "_", -1) == F.col("number"), "left_semi",
    )
    stored = ingestion.chunks_of(pages).withColumn("version", F.lit(1))
    new = ingestion.chunks_of(again).withColumn("version", F.lit(2)).withColumn("text", F.lower("text"))
    return retrieval.upsert_chunks(stored, new).select("chunk_id", "version", F.md5("text").alias("text_md5"))


@query
def q_collection_count(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.collection_count(_chunks(spark, folder))


# Projections, filters, predicates


@query
def q_filter_sku(spark: SparkSession, folder: str) -> DataFrame:
    return shown(inventory.filter_sku(src.demand_history(spark, folder), "SKU-000042"), "sku_id", "period", "net_units")


@query
def q_reorder_scan(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.reorder_scan(src.inventory(spark, folder)).select(
        "sku_id", "item_name", "total_available", "reorder_point", "status", "gap"
    )


@query
def q_stock_check(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.stock_check(src.inventory(spark, folder))


@query
def q_reorder_severity(spark: SparkSession, folder: str) -> DataFrame:
    scan = inventory.reorder_scan(src.inventory(spark, folder))
    return scan.select("sku_id", half_up(F.col("gap"), 1).alias("gap"), inventory.reorder_severity(F.col("gap")).alias("severity"))


@query
def q_anomaly_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all months, scaled to the range of forest decisions, with their severity."""
    scores = _rounded_scores(spark, folder).withColumn("decision", half_up(F.col("anomaly_score") / 10.0, 4))
    return shown(scores, "sku_id", "period", "decision").withColumn("severity", anomaly.anomaly_severity(F.col("decision")))


@query
def q_stock_table(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.stock_table(src.inventory(spark, folder))


@query
def q_calendar_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.with_calendar(src.demand_history(spark, folder))
    return shown(rows, "sku_id", "period", "month", "quarter", "is_high_season")


@query
def q_abc_encode(spark: SparkSession, folder: str) -> DataFrame:
    return src.inventory(spark, folder).select("sku_id", "abc_class", abc_weight(F.col("abc_class")).alias("abc_enc"))


@query
def q_drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.with_lags(src.demand_history(spark, folder)).na.drop(subset=["lag_1", "lag_3", "lag_6"])
    return shown(rows, "sku_id", "period", "net_units", "lag_1", "lag_3", "lag_6")


@query
def q_clip_negative(spark: SparkSession, folder: str) -> DataFrame:
    change = features.with_lags(src.demand_history(spark, folder)).withColumn("change", F.col("net_units") - F.col("lag_1"))
    rows = change.na.drop(subset=["change"]).withColumn("clipped", forecast.clipped(F.col("change")))
    return shown(rows, "sku_id", "period", "change", "clipped")


def _priced(spark: SparkSession, folder: str) -> DataFrame:
    terms = src.supplier_terms(spark, folder).select("supplier_id", "lead_time_days")
    orders = src.purchase_orders(spark, folder).join(terms, "supplier_id", "left").withColumns(
        {
            "lead_time_days": F.coalesce(F.col("lead_time_days").cast("double"), F.lit(fv.DEFAULT_LEAD_TIME_DAYS)),
            "qty": F.col("qty_ordered"),
            "unit_price": F.col("rate_per_unit"),
            "offset_days": F.pmod(F.col("qty_ordered").cast("long"), F.lit(16)) - 5,
        }
    )
    return inventory.po_pricing(orders)


@query
def q_po_pricing(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_priced(spark, folder), "po_number", "supplier_id", "subtotal", "gst", "total", "delivery_date")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return src.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("conv_id") % 14).alias("horizon")
    )


@query
def q_request_filter(spark: SparkSession, folder: str) -> DataFrame:
    one = inventory.request_filter(_requests(spark, folder))
    both = inventory.request_filter(one.withColumnRenamed("is_valid", "valid_for_one"), one_sku=False)
    return both.select("conv_id", "turn", "horizon", "valid_for_one", F.col("is_valid").alias("valid_for_all"))


# Joins


@query
def q_supplier_terms_join(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.terms_with_directory(src.supplier_terms(spark, folder), src.supplier_directory(spark, folder))


@query
def q_supplier_profile(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.supplier_profile(src.supplier_terms(spark, folder), src.supplier_directory(spark, folder))


@query
def q_sku_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge rebuilt from delimited lists of lower-cased codes, then joined to terms."""
    lists = src.supplier_sku_lists(spark, folder).withColumn("sku_list", readers.sku_list(F.lower("skus_supplied")))
    return suppliers.suppliers_of_skus(suppliers.sku_bridge(lists), src.supplier_terms(spark, folder))


@query
def q_sku_lead_time(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.sku_lead_time(src.supplier_sku(spark, folder), src.supplier_terms(spark, folder))


def _sold_skus(spark: SparkSession, folder: str) -> DataFrame:
    return src.table(spark, folder, "lineitem").select("l_partkey").distinct().select(
        src.sku_code(F.col("l_partkey") + 100).alias("sku_id")
    )


@query
def q_sku_stock_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """SKU numbers moved by 100, so that some are not stocked."""
    return inventory.sku_stock_lookup(_sold_skus(spark, folder), src.inventory(spark, folder))


@query
def q_sku_status_default(spark: SparkSession, folder: str) -> DataFrame:
    lead = suppliers.sku_lead_time(src.supplier_sku(spark, folder), src.supplier_terms(spark, folder))
    rows = inventory.sku_stock_lookup(_sold_skus(spark, folder), src.inventory(spark, folder)).join(lead, "sku_id", "left")
    return rows.select(
        "sku_id", "current_available",
        F.coalesce(F.col("lead_time_days").cast("double"), F.lit(fv.DEFAULT_LEAD_TIME_DAYS)).alias("lead_time_days"),
    )


@query
def q_semi_join_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase orders of the five SKUs with the highest demand."""
    leaders = profile.sku_summary(src.demand_history(spark, folder)).orderBy(F.desc("total_units"), "sku_id").limit(5)
    orders = src.purchase_orders(spark, folder).join(leaders.select("sku_id"), "sku_id", "left_semi")
    return shown(orders, "po_number", "sku_id", "qty_ordered")


@query
def q_period_sku_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = resample.period_sku_grid(src.demand_history(spark, folder))
    return shown(grid, "sku_id", "period", "abc_class", "units_sold", "units_returned", "net_units")


# Aggregations


@query
def q_sku_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = profile.sku_summary(src.demand_history(spark, folder)).orderBy(F.desc("total_units"), "sku_id")
    return shown(summary, avg_monthly=4, std_dev=4)


@query
def q_abc_units(spark: SparkSession, folder: str) -> DataFrame:
    return profile.abc_units(src.demand_history(spark, folder))


@query
def q_abc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.abc_counts(src.demand_history(spark, folder))


@query
def q_sku_demand_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.sku_demand_stats(src.demand_history(spark, folder))
    return shown(stats, avg_monthly=4, avg_daily=4, std_monthly=4)


@query
def q_recent_stats(spark: SparkSession, folder: str) -> DataFrame:
    return shown(profile.recent_stats(src.demand_history(spark, folder)), mean_3=4, std_6=4)


@query
def q_top_sku(spark: SparkSession, folder: str) -> DataFrame:
    return shown(profile.top_sku(src.demand_history(spark, folder)), avg_units=4)


@query
def q_distinct_skus(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(src.demand_history(spark, folder))


@query
def q_null_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Demand, inventory and orders, with the lags of demand as columns that hold nulls."""
    lagged = features.with_lags(src.demand_history(spark, folder))
    counted = profile.null_profile(
        {"demand": lagged, "inventory": src.inventory(spark, folder), "orders": src.purchase_orders(spark, folder)}
    )
    return shown(counted, missing_pct=4)


@query
def q_alert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return board.alert_counts(board.union_alerts(src.inventory(spark, folder), _anomalies(spark, folder)))


@query
def q_anomaly_rate(spark: SparkSession, folder: str) -> DataFrame:
    return shown(anomaly.anomaly_rate(_scored(spark, folder)), flagged_pct=4)


@query
def q_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Last month's units as prediction, over the whole history, per class."""
    rows = features.with_lags(src.demand_history(spark, folder)).na.drop(subset=["lag_1"])
    scored = rows.groupBy("abc_class").agg(profile.rmse(F.col("net_units"), F.col("lag_1")).alias("rmse"))
    return shown(scored, rmse=4)


@query
def q_mape(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.with_lags(src.demand_history(spark, folder)).na.drop(subset=["lag_1"])
    # Sold units are never 0, so the percentage stays readable.
    scored = rows.groupBy("abc_class").agg(profile.mape(F.col("units_sold"), F.col("lag_1")).alias("mape"))
    return shown(scored, mape=4)


@query
def q_standardize(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.standardize(_features(spark, folder), ["net_units", "lag_1", "roll_std_3"])
    return shown(rows, "sku_id", "period", "net_units_z", "lag_1_z", "roll_std_3_z", net_units_z=6, lag_1_z=6, roll_std_3_z=6)


@query
def q_score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(_rounded_scores(spark, folder), "anomaly_score", "is_anomaly")


# Windows


@query
def q_lag_features(spark: SparkSession, folder: str) -> DataFrame:
    return shown(features.with_lags(src.demand_history(spark, folder)), "sku_id", "period", "lag_1", "lag_3", "lag_6")


@query
def q_roll_mean_3(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.demand_history(spark, folder).withColumn("roll_mean_3", features.rolling_mean(3))
    return shown(rows, "sku_id", "period", "roll_mean_3", roll_mean_3=4)


@query
def q_roll_std_3(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.demand_history(spark, folder).withColumn("roll_std_3", features.rolling_std(3))
    return shown(rows, "sku_id", "period", "roll_std_3", roll_std_3=4)


@query
def q_roll_mean_6(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.demand_history(spark, folder).withColumn("roll_mean_6", features.rolling_mean(6))
    return shown(rows, "sku_id", "period", "roll_mean_6", roll_mean_6=4)


def _growth_shown(value: Column) -> Column:
    """Rounded growth; infinite growth stays as it is."""
    infinite = F.abs(value) == float("inf")
    return F.when(infinite, value).otherwise(half_up(F.when(~infinite, value), 4))


@query
def q_yoy_growth(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.with_growth(src.demand_history(spark, folder))
    return shown(rows.withColumn("yoy_growth", _growth_shown(F.col("yoy_growth"))), "sku_id", "period", "yoy_growth")


@query
def q_sku_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = _features(spark, folder).withColumn("yoy_growth", _growth_shown(F.col("yoy_growth")))
    return shown(
        rows, "sku_id", "period", "net_units", *fv.FEATURE_COLUMNS, roll_mean_3=4, roll_std_3=4, roll_mean_6=4
    )


@query
def q_supplier_rank(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.supplier_rank(_offers(spark, folder)).select(
        "sku_id", "supplier_id", "lead_rank", "on_time_rank", "score"
    )


@query
def q_last_row_per_sku(spark: SparkSession, folder: str) -> DataFrame:
    last = features.last_rows(_features(spark, folder), 1)
    return shown(last, "sku_id", "period", "net_units", "lag_1", "roll_mean_3", roll_mean_3=4)


@query
def q_history_tail(spark: SparkSession, folder: str) -> DataFrame:
    return shown(features.last_rows(src.demand_history(spark, folder), 12), "sku_id", "period", "net_units", "place")


# Sorts, limits, top-k


@query
def q_sort_sku_period(spark: SparkSession, folder: str) -> DataFrame:
    rows = src.demand_history(spark, folder).orderBy("sku_id", "period")
    return shown(rows, "sku_id", "period", "net_units")


@query
def q_top5_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.top_series(src.demand_history(spark, folder)).orderBy("sku_id", "period")
    return shown(rows, "sku_id", "period", "net_units")


@query
def q_supplier_performance(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.supplier_performance(src.supplier_directory(spark, folder))


@query
def q_alerts_order(spark: SparkSession, folder: str) -> DataFrame:
    return board.alerts(src.inventory(spark, folder), _anomalies(spark, folder)).select("sku_id", "alert_type", "severity")


@query
def q_anomaly_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = anomaly.first_anomalies_per_sku(_anomalies(spark, folder))
    return shown(capped, "sku_id", "period", "place", "anomaly_score", anomaly_score=4)


@query
def q_anomaly_scan_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = anomaly.first_anomalies(_anomalies(spark, folder), fv.SCAN_ANOMALY_CAP)
    return shown(capped, "sku_id", "period", "anomaly_score", anomaly_score=4)


@query
def q_top_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.flagged(_rounded_scores(spark, folder))
    return shown(anomaly.top_anomalies(rows), roll_mean_3=4)


@query
def q_supplier_cap(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.first_suppliers(_offers(spark, folder)).select("sku_id", "supplier_id", "place")


@query
def q_supplier_list(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.listed_suppliers(src.supplier_directory(spark, folder))


# Set operations


@query
def q_union_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return shown(board.union_alerts(src.inventory(spark, folder), _anomalies(spark, folder)))


@query
def q_distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    return resample.distinct_skus(src.demand_history(spark, folder))


# Scalar functions


@query
def q_scalar_string(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return src.table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.md5(F.lower(text)).alias("lower_md5"),
        F.md5(F.upper(F.col("role"))).alias("upper_md5"),
        text.startswith("The").alias("starts"),
        text.contains("er").alias("holds"),
        F.substring(F.btrim(text, F.lit(fv.BLANKS)), 1, 60).alias("prefix"),
        F.size(F.split(text, " ")).alias("word_count"),
        F.md5(F.array_join(F.split(text, " "), "; ")).alias("joined_md5"),
        F.regexp_replace(text, "[ \n]+", " ").alias("collapsed"),
    )


@query
def q_scalar_date(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = F.date_format(day, "dd-MM-yyyy")
    return src.table(spark, folder, "orders").select(
        "o_orderkey", text.alias("day_text"),
        F.to_date(text, "dd-MM-yyyy").cast("string").alias("parsed"),
        F.to_date(F.date_format(day, "yyyy-MM"), "yyyy-MM").cast("string").alias("month_start"),
        F.month(day).alias("month"), F.quarter(day).alias("quarter"),
        F.date_format(day, "MMM").alias("month_name"), F.date_format(day, "yyyy-MM").alias("year_month"),
        F.date_add(day, 45).cast("string").alias("plus_45"),
        F.add_months(day, -3).cast("string").alias("minus_3_months"),
    )


@query
def q_scalar_format(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.col("total_available") - F.col("reorder_point")
    return src.inventory(spark, folder).select(
        "sku_id", number_text(F.col("total_available")).alias("whole"), signed_text(gap).alias("signed"),
        number_text(F.col("days_of_stock") / 7.0, 3).alias("three_places"),
        F.format_string("SYN-%05d", "qty_on_hand").alias("padded"),
        F.sqrt(F.abs(gap).cast("double")).cast("decimal(18,4)").cast("string").alias("root"),
        F.greatest(gap, F.lit(0)).alias("clipped"),
        high_season(F.col("qty_wip")).alias("season_flag"),
    )


# Documents and retrieval


@query
def q_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with doubled spaces and newlines before cleaning, so that there is something to clean."""
    loose = F.concat(F.lit("\n "), F.regexp_replace(F.regexp_replace("text", "\n", "\n\n\n\n"), r"\. ", ".   "), F.lit("  \n"))
    rows = src.pages(spark, folder).withColumn("text", loose)
    return documents.clean_pages(rows).select("source", "page", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def q_doc_type(spark: SparkSession, folder: str) -> DataFrame:
    return src.pages(spark, folder).select("source", documents.doc_type(F.col("source")).alias("doc_type"))


@query
def q_chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select(
        "chunk_id", "chunk_index", "doc_type", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query
def q_chunk_id(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", "source", "page", "chunk_index", "collection")


@query
def q_chunk_boundary(spark: SparkSession, folder: str) -> DataFrame:
    chunks = documents.chunk_boundary(documents.clean_pages(src.pages(spark, folder)))
    return chunks.select("chunk_id", "chunk_index", "doc_type", F.length("text").alias("n_chars"), "text")


@query
def q_chunk_id_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of documents and of their upper-cased copies under the same ids; the first in order wins."""
    chunks = _chunks(spark, folder)
    copies = chunks.withColumn("chunk_index", F.col("chunk_index") + 1).withColumn("text", F.upper("text"))
    first = documents.first_per_chunk_id(copies.unionByName(chunks), ingestion.CHUNK_ORDER)
    return first.select("chunk_id", "chunk_index", F.md5("text").alias("text_md5"))


@query
def q_shingles(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents.shingle_rows(_chunks(spark, folder))
    return rows.select("chunk_id", F.md5("shingle").alias("shingle_md5"))


@query
def q_minhash_signature(spark: SparkSession, folder: str) -> DataFrame:
    signed = documents.minhash_signature(_chunks(spark, folder))
    digest = F.md5(F.array_join(F.col("signature").cast("array<string>"), ","))
    return signed.select("chunk_id", F.size("signature").alias("width"), digest.alias("signature_md5"))


@query
def q_near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_chunks(spark, folder), ingestion.CHUNK_ORDER)


@query
def q_near_dup_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_chunks(spark, folder), ingestion.CHUNK_ORDER, method="lsh")


@query
def q_dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.dedup_keep_first(_chunks(spark, folder), ingestion.CHUNK_ORDER).select("chunk_id")


@query
def q_embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return shown(retrieval.tfidf_rows(_chunks(spark, folder)), weight=6)


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = src.table(spark, folder, "embeddings")
    return vectors.withColumnRenamed("vec_id", "query_id"), vectors


@query
def q_knn_join(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.knn_join(*_vectors(spark, folder))


@query
def q_knn_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every vector from an index by random projections."""
    path = scratch_path(spark, "vector-index")
    queries, corpus = _vectors(spark, folder)
    nearest_index.build_index(corpus, path)
    return nearest_index.approximate_neighbours(queries, spark, path)


@query
def q_filtered_knn(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every vector among those with its own label."""
    return retrieval.knn_join(*_vectors(spark, folder), match="label")


def _searches(spark: SparkSession, folder: str) -> DataFrame:
    return src.questions(spark, folder).withColumnRenamed("question", "search_text")


@query
def q_text_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    index, idf = retrieval.text_index(_chunks(spark, folder))
    return retrieval.text_retrieve(_searches(spark, folder), index, idf).drop("exact")


def _typed_searches(spark: SparkSession, folder: str) -> DataFrame:
    place = F.length("search_text") % 3
    return _searches(spark, folder).withColumns(
        {
            "search_type": F.when(place == 0, "PO").when(place == 1, "catalog").otherwise("all"),
            "search_k": F.when(place == 2, 4).otherwise(3),
        }
    )


@query
def q_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.retrieve(_typed_searches(spark, folder), _chunks(spark, folder))
    return hits.select("query_id", "place", "chunk_id", "score")


@query
def q_retrieve_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.retrieve(_typed_searches(spark, folder), _chunks(spark, folder), merge="distance")
    return hits.select("query_id", "place", "chunk_id", "score")


@query
def q_retrieve_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Questions against the stored vectors of all chunks."""
    model = retrieval.word_count_model()
    path = scratch_path(spark, "vectors")
    chunks = retrieval.embed_chunks(_chunks(spark, folder), model).withColumn("version", F.lit(1))
    retrieval.write_collection(spark, chunks, path)
    return retrieval.retrieve_dense(_searches(spark, folder), retrieval.read_collection(spark, path), model, 3)


@query
def q_format_context(spark: SparkSession, folder: str) -> DataFrame:
    searches = _typed_searches(spark, folder)
    contexts = retrieval.format_context(searches, retrieval.retrieve(searches, _chunks(spark, folder)))
    return contexts.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


def _ingested(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    path = scratch_path(spark, "collections")
    ingestion.ingest(spark, src.pages(spark, folder), path, version=1, mode=mode)
    return retrieval.read_collection(spark, path)


@query
def q_ingest(spark: SparkSession, folder: str) -> DataFrame:
    stored = _ingested(spark, folder, "fixed")
    return stored.select("chunk_id", "collection", "doc_type", "version", F.md5("text").alias("text_md5"))


@query
def q_ingest_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.collection_count(_ingested(spark, folder, "boundary"))


# Forecasting


@query
def q_forecast_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast_fallback(src.demand_history(spark, folder))


@query
def q_forecast_all(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast_fallback(src.demand_history(spark, folder), horizon=6)


@query
def q_forecast_points(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts as arrays per SKU, taken apart into one row per month ahead."""
    points = forecast.forecast_fallback(src.demand_history(spark, folder), horizon=6)
    return forecast.points_from_arrays(forecast.arrays_from_points(points))


@query
def q_forecast_text(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast_text(forecast.forecast_fallback(src.demand_history(spark, folder)))


@query
def q_forecast_bands(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.sku_demand_stats(src.demand_history(spark, folder))
    banded = forecast.forecast_bands(stats, "avg_monthly", "std_monthly")
    return banded.select("sku_id", "lower_ci", "upper_ci")


@query
def q_cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    return shown(
        forecast.cv_folds(_features(spark, folder)).groupBy("fold", "part").agg(
            F.count("*").alias("row_count"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
        )
    )


@query
def q_cv_folds_by_row(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.cv_folds_by_row(_features(spark, folder)).groupBy("fold", "part").agg(
        F.count("*").alias("row_count"), F.min("sku_id").alias("first_sku"), F.max("sku_id").alias("last_sku")
    )


@query
def q_holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    return shown(forecast.holdout_split(_features(spark, folder)), "sku_id", "period", "part")


@query
def q_naive_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the rolling mean; the percentage is over sold units, which are never 0."""
    rows = forecast.naive_predictions(src.demand_history(spark, folder))
    scored = rows.agg(
        F.count("*").alias("row_count"),
        profile.rmse(F.col("net_units"), F.col("prediction")).alias("rmse"),
        profile.mape(F.col("units_sold"), F.col("prediction")).alias("mape"),
    )
    return shown(scored, rmse=4, mape=4)


@query
def q_actual_vs_pred(spark: SparkSession, folder: str) -> DataFrame:
    demand = src.demand_history(spark, folder)
    rows = profile.of_top_sku(forecast.naive_predictions(demand), demand)
    rows = rows.withColumn("prediction", forecast.clipped(F.col("prediction")))
    return shown(rows, "sku_id", "period", "net_units", "prediction", prediction=4)


def _model(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the model of all rows; trained once, stored and loaded."""

    def train(path: str) -> None:
        demand_model.save_model(demand_model.train(checkpointed(_features(spark, folder))), path)

    return demand_model.load_model(shared.stored_folder(spark, folder, "demand-model", train), spark)


@query
def q_train_demand(spark: SparkSession, folder: str) -> DataFrame:
    rows = _features(spark, folder)
    return shown(demand_model.predict(_model(spark, folder), rows), "sku_id", "period", "net_units", "prediction", prediction=2)


@query
def q_cv_train(spark: SparkSession, folder: str) -> DataFrame:
    return shown(demand_model.cv_train(checkpointed(_features(spark, folder))), rmse=4, mape=4)


@query
def q_holdout_eval(spark: SparkSession, folder: str) -> DataFrame:
    rows = demand_model.holdout_predictions(checkpointed(_features(spark, folder)))
    return shown(forecast.evaluate(rows), rmse=4, mape=4)


@query
def q_train_models(spark: SparkSession, folder: str) -> DataFrame:
    """The whole training job; its run table."""
    path = scratch_path(spark, "training")
    training.train_models(spark, src.demand_history(spark, folder), path)
    runs = spark.read.parquet(f"{path}/runs")
    return runs.select("run", F.explode("metrics").alias("metric", "value"))


@query
def q_forecast_model(spark: SparkSession, folder: str) -> DataFrame:
    return demand_model.forecast_model(_model(spark, folder), src.demand_history(spark, folder))


@query
def q_forecast_model_full(spark: SparkSession, folder: str) -> DataFrame:
    return demand_model.forecast_model(_model(spark, folder), src.demand_history(spark, folder), roll="full")


@query
def q_feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(demand_model.feature_importance(_model(spark, folder)), "feature string, importance double")


@query
def q_importance_sort(spark: SparkSession, folder: str) -> DataFrame:
    return q_feature_importance(spark, folder).orderBy("importance", "feature")


@query
def q_arima_by_sku(spark: SparkSession, folder: str) -> DataFrame:
    return arima.arima_by_sku(src.demand_history(spark, folder))


# Anomaly detection


@query
def q_anomaly_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.anomaly_features(_features(spark, folder))
    return shown(rows, roll_mean_3=4, roll_std_3=4)


@query
def q_zscore_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_scored(spark, folder), "sku_id", "period", "anomaly_score", "is_anomaly", anomaly_score=6)


@query
def q_zscore_per_sku(spark: SparkSession, folder: str) -> DataFrame:
    scored = anomaly.zscore_scores(anomaly.anomaly_features(_features(spark, folder)), "per_sku")
    return shown(scored, "sku_id", "period", "anomaly_score", "is_anomaly", anomaly_score=6)


@query
def q_detect_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_anomalies(spark, folder), roll_mean_3=4, anomaly_score=6)


@query
def q_contamination_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.contamination_sweep(_rounded_scores(spark, folder))


@query
def q_anomaly_overlay(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.of_top_sku(_scored(spark, folder), src.demand_history(spark, folder))
    return shown(rows, "sku_id", "period", "net_units", "is_anomaly")


@query
def q_iforest_fit(spark: SparkSession, folder: str) -> DataFrame:
    nodes = isolation_forest.fit_forest(anomaly.anomaly_features(_features(spark, folder)), ["sku_id", "period"])
    return shown(nodes, threshold=4)


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    """The forest of all months, with its offset; trained once, stored and loaded."""

    def train(path: str) -> None:
        rows = checkpointed(anomaly.anomaly_features(_features(spark, folder)))
        isolation_forest.save_forest(isolation_forest.train_forest(rows, ["sku_id", "period"]), path)

    return isolation_forest.load_forest(spark, shared.stored_folder(spark, folder, "forest", train))


def _forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        return isolation_forest.apply_forest(anomaly.anomaly_features(_features(spark, folder)), _forest(spark, folder))

    return shared.stored(spark, folder, "forest-scores", build)


def _forest_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.flagged(_forest_scores(spark, folder))


@query
def q_forest_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alert board on forest scores, whose range gives all severities."""
    return shown(board.alerts(src.inventory(spark, folder), _forest_anomalies(spark, folder)))


@query
def q_forest_anomaly_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """An alert for every month that the forest flags."""
    rows = _forest_anomalies(spark, folder)
    return shown(anomaly.anomaly_alerts(rows, rows.count()))


@query
def q_forest_contamination_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.contamination_sweep(_forest_scores(spark, folder))


@query
def q_forest_score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(_forest_scores(spark, folder), "anomaly_score", "is_anomaly")


@query
def q_forest_top_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return shown(anomaly.top_anomalies(_forest_anomalies(spark, folder)), roll_mean_3=4, anomaly_score=6)


@query
def q_forest_per_sku(spark: SparkSession, folder: str) -> DataFrame:
    """Every SKU against the stored forest of all: its flagged months and lowest score."""
    rows = anomaly.anomaly_features(_features(spark, folder))
    scored = isolation_forest.apply_forest(rows, _forest(spark, folder))
    by_sku = scored.groupBy("sku_id").agg(
        F.count("*").alias("months"), F.count_if("is_anomaly").alias("flagged"), F.min("anomaly_score").alias("lowest")
    )
    return shown(by_sku, lowest=6)


@query
def q_iforest_score(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_forest_scores(spark, folder), "sku_id", "period", "anomaly_score", "is_anomaly", anomaly_score=6)


@query
def q_iforest_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return shown(anomaly.flagged(_forest_scores(spark, folder)), roll_mean_3=4, anomaly_score=6)


# Composed queries


def _rop(spark: SparkSession, folder: str) -> DataFrame:
    lead = suppliers.sku_lead_time(src.supplier_sku(spark, folder), src.supplier_terms(spark, folder))
    stats = profile.sku_demand_stats(src.demand_history(spark, folder))
    return inventory.reorder_points(stats, lead, src.inventory(spark, folder))


@query
def q_rop(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_rop(spark, folder), avg_daily=4, safety_stock=4, rop=4)


@query
def q_rop_text(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.rop_text(_rop(spark, folder))


@query
def q_reorder_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.reorder_alerts(src.inventory(spark, folder))


@query
def q_reorder_scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    return answers.reorder_scan_lines(src.inventory(spark, folder))


@query
def q_anomaly_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return shown(anomaly.anomaly_alerts(_anomalies(spark, folder)))


@query
def q_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return shown(board.alerts(src.inventory(spark, folder), _anomalies(spark, folder)))


@query
def q_supplier_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers.recommend_supplier(_offers(spark, folder))


def _all_questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns, and one question about every SKU."""
    key = F.col("p_partkey")
    code = src.sku_code(key)
    about = src.table(spark, folder, "part").select(
        F.format_string("S%08d", key).alias("query_id"),
        F.when(key % 5 == 0, F.concat(F.lit("forecast demand for "), code, F.lit(" next month")))
        .when(key % 5 == 1, F.concat(F.lit("Is stock of "), F.lower(code), F.lit(" low, when to order?")))
        .when(key % 5 == 2, F.concat(F.lit("who is the best supplier for "), code, F.lit("?")))
        .when(key % 5 == 3, F.concat(F.lit("any unusual spike for "), code, F.lit("?")))
        .otherwise(F.concat(F.lit("hello, about "), code)).alias("question"),
    )
    general = src.table(spark, folder, "nation").select(
        F.format_string("N%08d", "n_nationkey").alias("query_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("which items need reordering in "), "n_name", F.lit("?")))
        .when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("any unusual outlier in "), "n_name"))
        .when(F.col("n_nationkey") % 5 == 2, F.concat(F.lit("which vendor serves "), "n_name"))
        .when(F.col("n_nationkey") % 5 == 3, F.concat(F.lit("any unusual demand anomalies in "), "n_name", F.lit("?")))
        .otherwise(F.concat(F.lit("hello "), "n_name")).alias("question"),
    )
    return src.questions(spark, folder).unionByName(about).unionByName(general)


@query
def q_sku_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _all_questions(spark, folder).select(
        "query_id", intents.sku_extract(F.col("question"), SKU_IN_TEXT).alias("sku_id"),
        intents.sku_extract(F.col("question")).alias("default_sku_id"),
    )


@query
def q_intent_score(spark: SparkSession, folder: str) -> DataFrame:
    return intents.with_intent_scores(_all_questions(spark, folder)).drop("question")


@query
def q_classify_intent(spark: SparkSession, folder: str) -> DataFrame:
    return intents.classify_intent(_all_questions(spark, folder), pattern=SKU_IN_TEXT).select("query_id", "intent", "sku_id")


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    top = profile.top_sku(src.demand_history(spark, folder)).select("sku_id").scalar()
    return intents.route(intents.classify_intent(_all_questions(spark, folder), pattern=SKU_IN_TEXT), top)


@query
def q_route(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("query_id", "handler", "target_sku")


@query
def q_rag_query_text(spark: SparkSession, folder: str) -> DataFrame:
    return intents.with_search_text(_routed(spark, folder)).select("query_id", "search_text", "search_k", "search_type")


@query
def q_answer_queries(spark: SparkSession, folder: str) -> DataFrame:
    return answers.answer_queries(
        _all_questions(spark, folder), src.demand_history(spark, folder), src.inventory(spark, folder),
        src.supplier_terms(spark, folder), src.supplier_directory(spark, folder), src.supplier_sku(spark, folder),
        _chunks(spark, folder), SKU_IN_TEXT,
    )


@query
def q_answer_queries_trained(spark: SparkSession, folder: str) -> DataFrame:
    """The answers with forecasts of the trained model and anomalies of the forest."""
    demand = src.demand_history(spark, folder)
    return answers.answer_queries(
        _all_questions(spark, folder), demand, src.inventory(spark, folder), src.supplier_terms(spark, folder),
        src.supplier_directory(spark, folder), src.supplier_sku(spark, folder), _chunks(spark, folder), SKU_IN_TEXT,
        points=demand_model.forecast_model(_model(spark, folder), demand), scored=_forest_scores(spark, folder),
    )


# Resampling


def _written_demand(spark: SparkSession, folder: str) -> DataFrame:
    """The demand history, written once: resampling numbers, counts and joins it, about ten reads in all."""
    return checkpointed(src.demand_history(spark, folder))


def _sample_rows(demand: DataFrame) -> int:
    """As many rows as the table has."""
    return demand.count()


@query
def q_bootstrap_demand(spark: SparkSession, folder: str) -> DataFrame:
    demand = _written_demand(spark, folder)
    return resample.bootstrap_demand(demand, _sample_rows(demand))


@query
def q_bootstrap_po(spark: SparkSession, folder: str) -> DataFrame:
    orders = src.purchase_orders(spark, folder)
    return shown(resample.bootstrap_po(orders, _sample_rows(orders)))


@query
def q_copula_sample(spark: SparkSession, folder: str) -> DataFrame:
    demand = _written_demand(spark, folder)
    return resample.copula_sample(demand, _sample_rows(demand))


@query
def q_extend_demand(spark: SparkSession, folder: str) -> DataFrame:
    demand = _written_demand(spark, folder)
    return shown(resample.extend_demand(demand, _sample_rows(demand)))


@query
def q_synthesize_po(spark: SparkSession, folder: str) -> DataFrame:
    part = src.table(spark, folder, "part").select(src.sku_code(F.col("p_partkey")).alias("sku_id"), "p_retailprice")
    offers = (
        src.supplier_sku(spark, folder).join(src.supplier_terms(spark, folder), "supplier_id").join(part, "sku_id")
        .select(
            "supplier_id", "sku_id", "lead_time_days", "min_order_qty",
            (F.col("p_retailprice") * 0.8).alias("price_low"), (F.col("p_retailprice") * 1.2).alias("price_high"),
        )
    )
    return shown(resample.synthesize_po(offers, _sample_rows(src.purchase_orders(spark, folder))))
