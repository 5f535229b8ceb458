"""Entity tables (named as in the relational schema) -> operator inputs.

The operators use a few uniform names: products.product_id, lines keyed by
(order_id, line_seq) with done_qty / unit_price, MO components with mo_id.
This is a pure renaming projection; Catalyst folds it into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operator_views(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    if "products" in t:
        out["products"] = t["products"].withColumnRenamed("id", "product_id")
    if "sales_orders" in t:
        out["sales_orders"] = t["sales_orders"]
    if "sales_order_lines" in t:
        out["sales_lines"] = t["sales_order_lines"].select(
            F.col("sales_order_id").alias("order_id"), F.col("id").alias("line_seq"), "product_id",
            "ordered_qty", F.col("delivered_qty").alias("done_qty"), "unit",
            F.col("sales_unit_price").alias("unit_price"))
    if "purchase_orders" in t:
        out["purchase_orders"] = t["purchase_orders"]
    if "purchase_order_lines" in t:
        out["purchase_lines"] = t["purchase_order_lines"].select(
            F.col("purchase_order_id").alias("order_id"), F.col("id").alias("line_seq"), "product_id",
            "ordered_qty", F.col("received_qty").alias("done_qty"), "unit",
            F.col("cost_price").alias("unit_price"))
    for name in ("manufacturing_orders", "mo_components", "mo_work_orders", "bom_operations", "vendors",
                 "users", "audit_logs", "stock_ledger"):
        if name in t:
            out[name] = t[name]
    if "bills_of_material" in t:
        out["boms"] = t["bills_of_material"]
    if "bom_components" in t:
        out["bom_components"] = t["bom_components"]
    if "user_module_permissions" in t:
        out["permissions"] = t["user_module_permissions"]
    return out
