"""Stock ledger: running on-hand balance (E1) and its checks (H8).

movements(product_id, movement_qty, <order columns...>)
opening(product_id, on_hand_qty)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact, exact_sum
from stockflow.operators.scan import prefix_scan
from stockflow.types import QTY_SUM


def ledger(movements: DataFrame, opening: DataFrame, order: Sequence[str], settle: bool = False) -> DataFrame:
    """Each movement with resulting_on_hand = opening + running sum of
    movements up to and including it, per product in ``order``.

    The opening balance enters the scan as one leading row per product, so
    the movements are never joined to the products. It comes first whatever
    the movements' order values are, null ones included. Hot products are
    split across tasks (see operators.scan; ``settle`` is for movements that
    are joins or scans themselves).
    """
    order = list(order)
    cols = movements.columns
    open_rows = opening.select(
        "product_id", F.col("on_hand_qty").alias("movement_qty"),
        *[F.lit(None).cast(movements.schema[c].dataType).alias(c)
          for c in cols if c not in ("product_id", "movement_qty")],
        F.lit(0).alias("_after_opening"))
    rows = movements.withColumn("_after_opening", F.lit(1)).unionByName(open_rows)
    run = prefix_scan(rows, ["product_id"], ["_after_opening", *order], exact("movement_qty"), "sum", "resulting_on_hand", settle=settle)
    return (run.filter(F.col("_after_opening") == 1).drop("_after_opening")
            .withColumn("resulting_on_hand", F.col("resulting_on_hand").cast(QTY_SUM)))


def final_on_hand(movements: DataFrame, opening: DataFrame) -> DataFrame:
    """On hand after all movements = opening + sum of movements, per product
    (products without movements keep their opening). Partial aggregation
    before the shuffle; the join is against one row per product."""
    net = movements.groupBy("product_id").agg(exact_sum("movement_qty", 3, QTY_SUM).alias("_net"))
    return (opening.select("product_id", "on_hand_qty").join(net, "product_id", "left")
            .select("product_id", (F.coalesce("on_hand_qty", F.lit(0)) + F.coalesce("_net", F.lit(0)))
                    .cast(QTY_SUM).alias("on_hand_qty")))


def check_ledger_balance(products: DataFrame, opening: DataFrame, movements: DataFrame) -> DataFrame:
    """H8: products whose on hand differs from opening + movements."""
    exp = final_on_hand(movements, opening).withColumnRenamed("on_hand_qty", "ledger_qty")
    return (products.select("product_id", F.col("on_hand_qty").cast(QTY_SUM).alias("on_hand_qty"))
            .join(exp, "product_id", "left")
            .withColumn("ledger_qty", F.coalesce("ledger_qty", F.lit(0)).cast(QTY_SUM))
            .filter(~F.col("on_hand_qty").eqNullSafe(F.col("ledger_qty"))))
