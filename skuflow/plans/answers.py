"""Answers to a table of questions: routing, one result text per handler, retrieved context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skuflow.functions import fixed_values as fv
from skuflow.functions.scalar import filled, number_text, one_value, signed_text
from skuflow.operators.anomaly import (
    anomaly_features, first_anomalies, first_anomalies_per_sku, flagged, month_text, zscore_scores,
)
from skuflow.operators.features import sku_features
from skuflow.operators.forecast import forecast_fallback, forecast_text
from skuflow.operators.intents import classify_intent, route, with_search_text
from skuflow.operators.inventory import reorder_points, reorder_scan, rop_text, stock_check
from skuflow.operators.profile import sku_demand_stats, top_sku
from skuflow.operators.retrieval import format_context, retrieve
from skuflow.operators.suppliers import (
    first_suppliers, listed_suppliers, recommend_supplier, sku_lead_time, supplier_profile, suppliers_of_skus,
)
from skuflow.session import checkpointed


def reorder_scan_lines(inventory: DataFrame) -> DataFrame:
    """One text line per SKU at or below its reorder point."""
    line = filled(
        fv.SCAN_LINE, sku=F.col("sku_id"), item=F.col("item_name"), available=number_text(F.col("total_available")),
        reorder_point=number_text(F.col("reorder_point")), gap=signed_text(F.col("gap")),
    )
    return reorder_scan(inventory).select("sku_id", line.alias("line"))


def reorder_scan_headline(inventory: DataFrame) -> Column:
    count = one_value(reorder_scan(inventory), F.count("*"))
    return F.when(count == 0, fv.SCAN_NOTHING).otherwise(filled(fv.SCAN_HEADLINE, count=count.cast("string")))


def anomaly_scan_text(anomalies: DataFrame) -> Column:
    """Count of flagged rows and the first ones, as one text."""
    line = filled(
        fv.ANOMALY_SCAN_LINE, sku=F.col("sku_id"), item=F.substring(F.coalesce("product_name", F.lit("")), 1, 20),
        month=month_text(F.col("period")), units=number_text(F.col("net_units")), average=number_text(F.col("roll_mean_3")),
        score=number_text(F.col("anomaly_score"), 3),
    )
    shown = first_anomalies(anomalies, fv.SCAN_ANOMALY_CAP).select("sku_id", "period", line.alias("line"))
    lines = one_value(shown, F.array_join(F.sort_array(F.collect_list(F.struct("sku_id", "period", "line")))["line"], "\n"))
    count = one_value(anomalies, F.count("*"))
    return F.when(count == 0, fv.ANOMALY_SCAN_NOTHING).otherwise(
        filled(fv.ANOMALY_SCAN, count=count.cast("string"), lines=lines)
    )


def sku_anomaly_text(anomalies: DataFrame) -> DataFrame:
    """Text of the first flagged months of every SKU that has any."""
    line = filled(
        fv.SKU_ANOMALY_LINE, month=month_text(F.col("period")), units=number_text(F.col("net_units")),
        average=number_text(F.col("roll_mean_3")), score=number_text(F.col("anomaly_score"), 3),
    )
    lines = first_anomalies_per_sku(anomalies).groupBy("sku_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))["line"], "\n").alias("lines")
    )
    return lines.select(
        "sku_id", filled(fv.SKU_ANOMALIES, sku=F.col("sku_id"), lines=F.col("lines")).alias("anomaly_text")
    )


def supplier_text(terms: DataFrame, directory: DataFrame, offers: DataFrame) -> DataFrame:
    """Profiles of the first suppliers of each key of ``offers`` and the recommendation among all of them."""
    profiles = supplier_profile(terms, directory).select("supplier_id", "profile_text")
    shown = first_suppliers(offers.select("sku_id", "supplier_id")).join(profiles, "supplier_id")
    joined = shown.groupBy("sku_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "profile_text")))["profile_text"], "\n\n").alias("profiles")
    )
    best = recommend_supplier(offers.where(F.col("lead_time_days").isNotNull())).select("sku_id", "recommendation")
    return joined.join(best, "sku_id", "left").select(
        "sku_id", F.concat_ws("\n\n", "profiles", "recommendation").alias("supplier_text")
    )


def answer_queries(
    questions: DataFrame, demand: DataFrame, inventory: DataFrame, terms: DataFrame, directory: DataFrame,
    bridge: DataFrame, chunks: DataFrame, pattern: str = fv.SKU_PATTERN,
    points: DataFrame | None = None, scored: DataFrame | None = None,
) -> DataFrame:
    """(query_id, question, intent, sku_id, answer, context_used) for every row of (query_id, question).

    ``points`` are three-month forecasts of a trained model and ``scored`` the months scored by a forest;
    without them forecasts are rolling means and anomalies z-scores. A reorder question without SKU is answered with
    the number of SKUs to order; ``reorder_scan_lines`` is the list, as a table of its own, because its
    length grows with the inventory. Texts are built only for the SKUs that are asked for.
    """
    top = top_sku(demand).select("sku_id").scalar()
    routed = checkpointed(with_search_text(route(classify_intent(questions, pattern=pattern), top)))
    contexts = format_context(routed, retrieve(routed, chunks))
    asked = routed.join(contexts, "query_id")

    def targets(handler: str) -> DataFrame:
        rows = routed.where((F.col("handler") == handler) & (F.col("target_sku") != ""))
        return rows.select(F.col("target_sku").alias("sku_id")).distinct()

    def only(df: DataFrame, handler: str) -> DataFrame:
        return df.join(targets(handler), "sku_id", "left_semi")

    sku = F.col("target_sku")
    points = forecast_fallback(only(demand, "demand")) if points is None else only(points, "demand")
    if scored is None:
        of_skus = flagged(zscore_scores(anomaly_features(sku_features(only(demand, "anomaly"))), "per_sku"))
        everywhere = flagged(zscore_scores(anomaly_features(sku_features(demand))))
    else:
        everywhere = flagged(scored)
        of_skus = only(everywhere, "anomaly")
    answers = [
        _demand_answers(asked, forecast_text(points), sku),
        _reorder_answers(
            asked,
            stock_check(only(inventory, "reorder")).select("sku_id", "stock_text"),
            rop_text(
                reorder_points(
                    sku_demand_stats(only(demand, "reorder")), sku_lead_time(only(bridge, "reorder"), terms), inventory
                )
            ),
            reorder_scan_headline(inventory),
            sku,
        ),
        _supplier_answers(asked, terms, directory, suppliers_of_skus(only(bridge, "supplier"), terms)),
        _anomaly_answers(asked, everywhere, of_skus, sku),
    ]
    return reduce(DataFrame.unionByName, answers).select(
        "query_id", "question", "intent", "sku_id", "answer", (F.length("context") > 0).alias("context_used")
    )


def _of(asked: DataFrame, handler: str) -> DataFrame:
    return asked.where(F.col("handler") == handler)


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts.withColumnRenamed("sku_id", "target_sku"), "target_sku", "left")


def _answered(rows: DataFrame, answer: Column) -> DataFrame:
    return rows.select("query_id", "question", "intent", "sku_id", "context", answer.alias("answer"))


def _demand_answers(asked: DataFrame, texts: DataFrame, sku: Column) -> DataFrame:
    rows = _with_text(_of(asked, "demand"), texts)
    body = F.coalesce("forecast_text", filled(fv.NO_FORECAST, sku=sku))
    context = filled(fv.HISTORICAL_CONTEXT, context=F.substring("context", 1, 400))
    full = filled(fv.DEMAND_ANSWER, sku=sku, body=body, context=context)
    return _answered(rows, F.btrim(full, F.lit(" \t\n\r\f")))


def _reorder_answers(asked: DataFrame, stock: DataFrame, rop: DataFrame, headline: Column, sku: Column) -> DataFrame:
    rows = _with_text(_with_text(_of(asked, "reorder"), stock), rop)
    one = F.concat(
        F.coalesce("stock_text", filled(fv.NO_STOCK, sku=sku)),
        F.lit("\n\n"),
        F.coalesce("rop_text", filled(fv.NO_HISTORY, sku=sku)),
    )
    return _answered(rows, F.when(sku == "", headline).otherwise(one))


def _supplier_answers(asked: DataFrame, terms: DataFrame, directory: DataFrame, offers: DataFrame) -> DataFrame:
    # Without a SKU the first suppliers of the directory stand under the empty code, as one text. The code
    # is cut from a column, because a constant would leave the joins inside without a key.
    listed = listed_suppliers(directory).select(F.substring("supplier_id", 1, 0).alias("sku_id"), "supplier_id").join(
        terms.select("supplier_id", "supplier_name", "lead_time_days", "on_time_rate_pct"), "supplier_id", "left"
    )
    first_text = supplier_text(terms, directory, listed).select("supplier_text").scalar()
    rows = _with_text(_of(asked, "supplier"), supplier_text(terms, directory, offers))
    text = F.when(F.col("target_sku") == "", first_text).otherwise(F.col("supplier_text"))
    return _answered(rows, F.coalesce(text, F.lit(fv.NO_SUPPLIER)))


def _anomaly_answers(asked: DataFrame, everywhere: DataFrame, of_skus: DataFrame, sku: Column) -> DataFrame:
    rows = _with_text(_of(asked, "anomaly"), sku_anomaly_text(of_skus))
    one = F.coalesce("anomaly_text", filled(fv.NO_SKU_ANOMALIES, sku=sku))
    body = F.when(sku == "", anomaly_scan_text(everywhere)).otherwise(one)
    context = F.when(F.col("context") == fv.NO_DOCUMENTS, "").otherwise(
        F.concat(F.lit("\n\n"), filled(fv.HISTORICAL_CONTEXT, context=F.substring("context", 1, 500)))
    )
    return _answered(rows, filled(fv.ANOMALY_ANSWER, body=body, context=context))
