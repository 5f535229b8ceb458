"""Supply over all levels of the bills of material.

What is short and procured on demand raises supply; what is made needs its
components, which may be short and procured on demand in turn. A product that
several others need is planned once, after all of them: products are taken
level by level, each as soon as nothing that is still open needs it. Products
on a cycle, and what only such products need, are never taken and reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact_sum
from stockflow.operators.reach import reached
from stockflow.stored import store
from stockflow.types import QTY_SUM


def supply_plan(demand: DataFrame, products: DataFrame, bom_components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, cycles).

    demand(product_id, quantity): what is short, net of stock;
    products(product_id, free_qty, procure_on_demand, procurement_type, bom_id);
    bom_components(bom_id, component_product_id, to_consume_qty).

    plan(product_id, level, demand_qty, needed_qty, net_qty, supply): per
    product its demand, what products above it need, and the net of both: free
    stock covers needs, the demand is net already. ``supply`` is the
    procurement type where the product is procured on demand and something is
    needed, else null. A made product needs its components times its net
    quantity (not divided by the BoM's quantity). Levels count from 0; a
    product's is one more than the deepest product that needs it.

    cycles(product_id): products whose needs never end, being on a cycle of
    BoMs or below one; they have no plan. Demand without a product row is
    planned with no stock and no supply; null ids take no part.

    Rounds follow the depth of the BoMs. A round reads the products that are
    still open, which are dimension rows.
    """
    wanted = demand.filter("product_id is not null").groupBy("product_id").agg(exact_sum("quantity", 3, QTY_SUM).alias("demand_qty"))
    on_demand = F.coalesce("procure_on_demand", F.lit(False))
    known = products.select("product_id", F.greatest(F.coalesce("free_qty", F.lit(0)), F.lit(0)).cast(QTY_SUM).alias("free_qty"),
                            F.when(on_demand, F.col("procurement_type")).alias("type"), "bom_id")
    parts = (bom_components.filter("component_product_id is not null").groupBy("bom_id", F.col("component_product_id").alias("part_id"))
             .agg(exact_sum("to_consume_qty", 3, QTY_SUM).alias("each_qty")))
    edges = store(known.filter("type = 'Manufacturing'").join(parts, "bom_id").select("product_id", "part_id", "each_qty"), "edges")
    wanted = store(wanted, "wanted")
    nodes = reached(wanted, edges, ["product_id"], ["part_id"])
    edges = store(edges.join(nodes, "product_id", "left_semi"), "edges")
    waits = edges.groupBy(F.col("part_id").alias("product_id")).agg(F.count("*").alias("waits"))
    zero = F.lit(0).cast(QTY_SUM)
    left = store(nodes.join(wanted, "product_id", "left").join(waits, "product_id", "left").join(known.drop("bom_id"), "product_id", "left")
                 .select("product_id", F.coalesce("demand_qty", zero).alias("demand_qty"), F.coalesce("waits", F.lit(0)).alias("waits"),
                         zero.alias("needed_qty"), F.coalesce("free_qty", zero).alias("free_qty"), "type"), "open")
    levels: list[DataFrame] = []
    while True:
        net = F.col("demand_qty") + F.greatest(F.col("needed_qty") - F.col("free_qty"), F.lit(0))
        ready = store(left.filter("waits = 0").select(
            "product_id", F.lit(len(levels)).alias("level"), "demand_qty", "needed_qty", net.cast(QTY_SUM).alias("net_qty"),
            F.when(net > 0, F.col("type")).alias("supply")), "level")
        if ready.isEmpty():
            break
        levels.append(ready)
        sent = (edges.join(ready.select("product_id", "net_qty"), "product_id").groupBy(F.col("part_id").alias("product_id"))
                .agg(exact_sum(F.col("net_qty") * F.col("each_qty"), 3, QTY_SUM).alias("_more"), F.count("*").alias("_done")))
        left = store(left.filter("waits > 0").join(sent, "product_id", "left").select(
            "product_id", "demand_qty", (F.col("waits") - F.coalesce("_done", F.lit(0))).alias("waits"),
            (F.col("needed_qty") + F.coalesce("_more", zero)).cast(QTY_SUM).alias("needed_qty"), "free_qty", "type"), "open")
    plan = levels[0] if levels else ready
    for more in levels[1:]:
        plan = plan.unionByName(more)
    return plan, left.select("product_id")


def supply_components(plan: DataFrame, products: DataFrame, bom_components: DataFrame) -> DataFrame:
    """(product_id, level, part_id, to_consume_qty): the components of every
    draft manufacturing order of a plan (C6 on all levels)."""
    made = plan.filter("supply = 'Manufacturing'").join(products.select("product_id", "bom_id"), "product_id")
    return (made.join(bom_components, "bom_id")
            .select("product_id", "level", F.col("component_product_id").alias("part_id"),
                    (F.col("net_qty") * F.col("to_consume_qty")).cast(QTY_SUM).alias("to_consume_qty")))
