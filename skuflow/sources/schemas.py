"""Explicit schemas of the CSV sources; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


# Columns as the files hold them. Dates and months are parsed after reading.
DEMAND = _struct(
    "record_id:s period:s month:s year:l sku_id:s product_name:s abc_class:s channel:s "
    "units_sold:d units_returned:d net_units:d revenue_inr:d"
)
INVENTORY = _struct(
    "sku_id:s item_name:s item_type:s abc_class:s unit:s qty_on_hand:l qty_wip:l qty_in_transit:l "
    "total_available:l reorder_point:l days_of_stock:d status:s snapshot_date:s location:s"
)
SUPPLIER_DIRECTORY = _struct(
    "supplier_id:s supplier_name:s city:s state:s contact_person:s phone:s category:s payment_terms:s "
    "on_time_rate_pct:d bank:s gstin:s status:s"
)
SUPPLIER_TERMS = _struct(
    "supplier_id:s supplier_name:s skus_supplied:s lead_time_days:l min_order_qty:l credit_days:l "
    "advance_pct:d price_valid_until:s on_time_rate_pct:d penalty_clause:s last_audit_date:s notes:s"
)
PURCHASE_ORDERS = _struct(
    "po_number:s po_date:s supplier_id:s sku_id:s qty_ordered:d rate_per_unit_inr:d po_value_inr:d"
)
SALES_INVOICES = _struct("invoice_id:s invoice_date:s customer_id:s status:s total_inr:d")
