"""K2: procurement plan from shortages.

For products procured on demand, each open sales order that is short
raises draft supply: 'Purchase' products -> one draft purchase order per
(order, vendor) with a line per product; 'Manufacturing' products -> one
draft manufacturing order per (order, product) with the product's BoM,
whose components come from the BoM (C6). Open incoming supply is not
netted (none is in the reference either). All steps are joins and
aggregates keyed by order, so they scale with the shortage rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact_sum, reference_code
from stockflow.operators.bom import instantiate_components
from stockflow.types import QTY_SUM


def procurement_plan(shortages: DataFrame, products: DataFrame, bom_components: DataFrame,
                     order_prefix: str = "SO") -> dict[str, DataFrame]:
    """Returns {'purchase_lines', 'manufacturing_orders', 'mo_components'}.

    shortages(order_id, product_id, short_qty) as from stock.shortages.
    """
    p = products.filter(F.coalesce(F.col("procure_on_demand"), F.lit(False))).select(
        "product_id", "procurement_type", "vendor_id", "bom_id")
    need = (shortages.filter(F.col("short_qty") > 0)
            .groupBy("order_id", "product_id").agg(exact_sum("short_qty", 3, QTY_SUM).alias("quantity"))
            .join(p, "product_id"))
    note = reference_code(order_prefix, F.col("order_id") + 1)
    po_lines = (need.filter(F.col("procurement_type") == "Purchase")
                .select(F.col("order_id").alias("source_order_id"), "vendor_id", "product_id", "quantity",
                        F.lit("Draft").alias("status"), note.alias("source_note")))
    mos = (need.filter(F.col("procurement_type") == "Manufacturing")
           .select(F.col("order_id").alias("source_order_id"),
                   F.col("product_id").alias("finished_product_id"), "bom_id", "quantity",
                   F.lit("Draft").alias("status"), note.alias("source_note")))
    keyed = mos.withColumn("id", F.concat_ws("-", F.col("source_order_id").cast("string"),
                                             F.col("finished_product_id").cast("string")))
    comps = instantiate_components(keyed.select("id", "bom_id", "quantity"), bom_components)
    return {"purchase_lines": po_lines, "manufacturing_orders": mos, "mo_components": comps}
