"""Bills of material and their instantiation on manufacturing orders
(C4-C7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import or_default
from stockflow.types import DURATION_SUM, QTY, QTY_SUM


def with_finished_product(df: DataFrame, products: DataFrame,
                          col: str = "finished_product_id") -> DataFrame:
    """C4: inner join on the finished product; rows without it are dropped."""
    p = products.select(F.col("product_id").alias(col),
                        F.col("product_name").alias("finished_product_name"))
    return df.join(p, col)


def bom_component_names(components: DataFrame, products: DataFrame) -> DataFrame:
    """Component name, quantity (0/null -> 1) and unit (product's unit if
    the component has none)."""
    punit = [F.col("unit")] if "unit" in products.columns else []
    p = products.select(F.col("product_id").alias("component_product_id"),
                        F.col("product_name").alias("component_name"),
                        F.coalesce(*punit, F.lit("Units")).alias("_punit"))
    cunit = [F.col("unit")] if "unit" in components.columns else []
    return (components.join(p, "component_product_id", "left")
            .withColumn("to_consume_qty", or_default("to_consume_qty", F.lit(1)).cast(QTY))
            .withColumn("unit", F.coalesce(*cunit, F.col("_punit")))
            .drop("_punit"))


def instantiate_components(mos: DataFrame, bom_components: DataFrame) -> DataFrame:
    """MO components = BoM component qty x MO quantity (0/null -> 1),
    consumed 0. Single level; not divided by the BoM's own quantity."""
    m = mos.select(F.col("id").alias("mo_id"), "bom_id",
                   or_default("quantity", F.lit(1)).alias("_mult"))
    return (m.join(bom_components, "bom_id")
            .select("mo_id", F.col("component_product_id").alias("product_id"),
                    (F.col("to_consume_qty") * F.col("_mult")).cast(QTY_SUM).alias("to_consume_qty"),
                    F.lit(0).cast(QTY_SUM).alias("consumed_qty")))


def instantiate_operations(mos: DataFrame, bom_operations: DataFrame,
                           scale_duration: bool = False) -> DataFrame:
    """C7 (K3): MO work orders copied from the BoM operations; with
    ``scale_duration`` the expected duration is multiplied by the MO quantity."""
    m = mos.select(F.col("id").alias("mo_id"), "bom_id",
                   or_default("quantity", F.lit(1)).alias("_mult"))
    dur = F.col("expected_duration") * (F.col("_mult") if scale_duration else F.lit(1))
    return (m.join(bom_operations, "bom_id")
            .select("mo_id", "operation_name", "work_center",
                    dur.cast(DURATION_SUM).alias("expected_duration"),
                    F.lit(0).cast(DURATION_SUM).alias("real_duration"),
                    F.lit("Draft").alias("status")))
