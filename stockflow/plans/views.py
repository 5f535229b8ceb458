"""The reference's summary views as Spark temp views, for SQL users.

``register_views`` builds the operator outputs once (lazily) and registers
them, so ``spark.sql("select * from sales_order_summary where ...")`` runs
through Catalyst like any other query. Nested views use the guarded nested
form (see operators.summaries); ``*_lines`` views are the flat forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.operators import boards, bom, stock, summaries


def register_views(spark: SparkSession, t: dict[str, DataFrame], as_of: str, user_id: int,
                   nested: bool = True) -> list[str]:
    """Register summary views over operator inputs ``t`` (names as returned by
    sources.entities.operator_views, or the test model). Returns the view
    names."""
    mo_comps = t.get("mo_components")
    if mo_comps is None:
        mo_comps = bom.instantiate_components(t["manufacturing_orders"], t["bom_components"])
    work_orders = t.get("mo_work_orders")
    if work_orders is None:
        work_orders = bom.instantiate_operations(t["manufacturing_orders"], t["bom_operations"])
    reserved = stock.reserved_all(t["sales_orders"], t["sales_lines"], t["manufacturing_orders"], mo_comps)
    position = stock.stock_position(t["products"], reserved)
    views = {
        "stock_position": position,
        "dashboard": boards.dashboard(t["sales_orders"], t["purchase_orders"], t["manufacturing_orders"],
                                      user_id, as_of),
        "sales_order_lines_view": summaries.sales_order_summary(
            t["sales_orders"], t["sales_lines"], t["products"], t["users"], position, flat=True),
        "purchase_order_lines_view": summaries.purchase_order_summary(
            t["purchase_orders"], t["purchase_lines"], t["products"], t["users"], flat=True),
    }
    if nested:
        views["sales_order_summary"] = summaries.sales_order_summary(
            t["sales_orders"], t["sales_lines"], t["products"], t["users"], position, flat=False)
        views["purchase_order_summary"] = summaries.purchase_order_summary(
            t["purchase_orders"], t["purchase_lines"], t["products"], t["users"], flat=False)
        views["manufacturing_order_summary"] = summaries.manufacturing_order_summary(
            t["manufacturing_orders"], mo_comps, work_orders, t["products"], t["users"], position, flat=False)
        views["bom_summary"] = summaries.bom_summary(t["boms"], t["bom_components"], t["bom_operations"],
                                                     t["products"], flat=False)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
