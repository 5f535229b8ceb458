"""Derived stock: reserved, free-to-use, availability, shortages (D1-D3, C10,
G11, K1).

Inputs use the model's column names:
  products(product_id, on_hand_qty, ...)
  orders(id, status), lines(order_id, line_seq, product_id, ordered_qty, done_qty)
  mos(id, status), mo_components(mo_id, product_id, to_consume_qty, consumed_qty)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import availability, exact, exact_sum
from stockflow.operators.scan import prefix_scan
from stockflow.types import OPEN_MO, OPEN_SALES, QTY_SUM


def _outstanding(need: str, done: str) -> Column:
    # max(0, need - done); a null done counts as 0 as in the reference.
    return F.greatest(F.col(need) - F.coalesce(F.col(done), F.lit(0)), F.lit(0))


def open_sales_lines(orders: DataFrame, lines: DataFrame,
                     statuses=OPEN_SALES) -> DataFrame:
    """Lines of orders in the given statuses (semi join keeps line columns)."""
    open_orders = orders.filter(F.col("status").isin(*statuses)).select(F.col("id").alias("order_id"))
    return lines.join(open_orders, "order_id", "left_semi")


def _with_all_products(reserved: DataFrame, products: DataFrame | None) -> DataFrame:
    if products is None:
        return reserved
    return (products.select("product_id").join(reserved, "product_id", "left")
            .select("product_id", F.coalesce("reserved_qty", F.lit(0)).cast(QTY_SUM).alias("reserved_qty")))


def reserved_sales(orders: DataFrame, lines: DataFrame,
                   products: DataFrame | None = None) -> DataFrame:
    """Per product, sum of max(0, ordered - delivered) over lines of
    Confirmed / Partially Delivered orders. With ``products``, every product
    is listed and products without open lines get 0."""
    res = (open_sales_lines(orders, lines)
           .groupBy("product_id")
           .agg(exact_sum(_outstanding("ordered_qty", "done_qty"), 3, QTY_SUM).alias("reserved_qty")))
    return _with_all_products(res, products)


def reserved_all(orders: DataFrame, lines: DataFrame, mos: DataFrame,
                 mo_components: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """D1 union all open MO component needs (Confirmed / In Progress),
    grouped per product."""
    sales = (open_sales_lines(orders, lines)
             .select("product_id", _outstanding("ordered_qty", "done_qty").alias("qty")))
    open_mos = mos.filter(F.col("status").isin(*OPEN_MO)).select(F.col("id").alias("mo_id"))
    comps = (mo_components.join(open_mos, "mo_id", "left_semi")
             .select("product_id", _outstanding("to_consume_qty", "consumed_qty").alias("qty")))
    res = (sales.unionByName(comps).groupBy("product_id")
           .agg(exact_sum("qty", 3, QTY_SUM).alias("reserved_qty")))
    return _with_all_products(res, products)


def apply_reserved(products: DataFrame, reserved: DataFrame) -> DataFrame:
    """UPDATE ... FROM: products with a reserved row take it, the others
    keep their current reserved_qty."""
    r = reserved.select("product_id", F.col("reserved_qty").alias("_new"))
    return (products.join(r, "product_id", "left")
            .withColumn("reserved_qty", F.coalesce(F.col("_new").cast(QTY_SUM),
                                                   F.col("reserved_qty").cast(QTY_SUM)))
            .drop("_new"))


def stock_position(products: DataFrame, reserved: DataFrame) -> DataFrame:
    """D3: on hand, reserved and free-to-use (= on hand - reserved)."""
    return (products.select("product_id", "on_hand_qty")
            .join(reserved, "product_id", "left")
            .select("product_id",
                    F.coalesce("on_hand_qty", F.lit(0)).cast(QTY_SUM).alias("on_hand_qty"),
                    F.coalesce("reserved_qty", F.lit(0)).cast(QTY_SUM).alias("reserved_qty"),
                    (F.coalesce("on_hand_qty", F.lit(0)) - F.coalesce("reserved_qty", F.lit(0)))
                    .cast(QTY_SUM).alias("free_qty")))


def line_availability(lines: DataFrame, position: DataFrame, need: str = "ordered_qty",
                      mode: str = "sales") -> DataFrame:
    """G11 on lines: availability at read time from a stock position."""
    pos = position.select("product_id", "on_hand_qty", "reserved_qty")
    return (lines.join(pos, "product_id", "left")
            .withColumn("availability", availability(need, "on_hand_qty", "reserved_qty", mode))
            .drop("on_hand_qty", "reserved_qty"))


def stock_overview(products: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Flagship: per product on hand, reserved (sales scope), free, the number
    of open sales lines and how many of them ask for more than is free.

    Two passes over the open lines: (1) reserved per product (partial
    aggregation map-side); (2) the lines joined to their product's reserved
    and on-hand, counted in one aggregate. The join in (2) is against one
    row per product: broadcast by AQE when small, otherwise a shuffle join
    whose hot-product partitions AQE's skew handling splits.
    """
    open_lines = open_sales_lines(orders, lines).select(
        "product_id", "ordered_qty", _outstanding("ordered_qty", "done_qty").alias("out"))
    reserved = open_lines.groupBy("product_id").agg(exact_sum("out", 3, QTY_SUM).alias("reserved_qty"))
    onhand = products.select("product_id", F.coalesce("on_hand_qty", F.lit(0)).alias("_oh"))
    free = (F.col("_oh") - F.col("reserved_qty"))
    per_product = (open_lines.select("product_id", "ordered_qty")
                   .join(reserved.join(onhand, "product_id", "left")
                         .select("product_id", "reserved_qty", F.coalesce(free, -F.col("reserved_qty")).alias("_free")),
                         "product_id")
                   .groupBy("product_id")
                   .agg(F.first("reserved_qty").alias("reserved_qty"), F.count("*").alias("open_lines"),
                        F.count_if(F.col("ordered_qty") > F.col("_free")).alias("shortage_lines")))
    return (products.select("product_id", "on_hand_qty").join(per_product, "product_id", "left")
            .select("product_id",
                    F.coalesce("on_hand_qty", F.lit(0)).cast(QTY_SUM).alias("on_hand_qty"),
                    F.coalesce("reserved_qty", F.lit(0)).cast(QTY_SUM).alias("reserved_qty"),
                    (F.coalesce("on_hand_qty", F.lit(0)) - F.coalesce("reserved_qty", F.lit(0)))
                    .cast(QTY_SUM).alias("free_qty"),
                    F.coalesce("open_lines", F.lit(0)).cast("bigint").alias("open_lines"),
                    F.coalesce("shortage_lines", F.lit(0)).cast("bigint").alias("shortage_lines")))


def shortages(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """K1: shortage per open sales line, served in order of (creation_date,
    order id, line_seq) within each product.

    short = least(outstanding, greatest(cum_outstanding - greatest(on_hand, 0), 0)).
    The line shortages of a product add up to greatest(total outstanding -
    on_hand, 0). Hot products are split (see operators.scan).
    """
    o = orders.filter(F.col("status").isin(*OPEN_SALES)).select(
        F.col("id").alias("order_id"), "creation_date")
    ln = (lines.join(o, "order_id")
          .select("order_id", "line_seq", "product_id", "creation_date",
                  _outstanding("ordered_qty", "done_qty").alias("outstanding_qty")))
    cum = prefix_scan(ln, ["product_id"], ["creation_date", "order_id", "line_seq"],
                      exact("outstanding_qty"), "sum", "cum_outstanding", settle=True)
    cum = cum.withColumn("cum_outstanding", F.col("cum_outstanding").cast(QTY_SUM))
    onhand = products.select("product_id", F.greatest("on_hand_qty", F.lit(0)).alias("_oh"))
    return (cum.join(onhand, "product_id", "left")
            .select("order_id", "line_seq", "product_id",
                    F.col("outstanding_qty").cast(QTY_SUM).alias("outstanding_qty"),
                    F.least("outstanding_qty",
                            F.greatest(F.col("cum_outstanding") - F.coalesce("_oh", F.lit(0)), F.lit(0)))
                    .cast(QTY_SUM).alias("short_qty")))
