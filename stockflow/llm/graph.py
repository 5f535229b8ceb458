"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (src, dst; long, not null):
    component is the least id reachable.

    Each round moves every node to its least neighbour, follows these moves to
    their ends (by doubling: a chain of n moves takes log2(n) joins), renames
    the edges and drops those that became loops; the rounds' moves are
    composed. A path of rising ids is one round, and every round at least
    halves the nodes with edges. Nothing is gathered per node or on the driver.
    """
    live = store(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    place = None
    while not live.isEmpty():
        both = live.union(live.select("dst", "src"))
        moves = store(both.groupBy("src").agg(F.min("dst").alias("least")).select(
            F.col("src").alias("node"), F.least("src", "least").alias("to")), "moves")
        while True:
            hop = moves.select(F.col("node").alias("at"), F.col("to").alias("next"))
            on = store(moves.join(hop.filter("at <> next"), F.col("to") == F.col("at"), "left").select(
                "node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "moves")
            moves = on.select("node", "to")
            if on.filter("moved").isEmpty():
                break
        if place is None:
            place = moves.select(F.col("node").alias("id"), F.col("to").alias("component"))
        else:
            place = store(place.join(moves, F.col("component") == F.col("node"), "left")
                          .select("id", F.coalesce("to", "component").alias("component")), "components")
        one = live.join(moves, F.col("src") == F.col("node")).select(F.col("to").alias("a"), "dst")
        two = one.join(moves, F.col("dst") == F.col("node")).select("a", F.col("to").alias("b")).filter("a <> b")
        live = store(two.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    return place if place is not None else live.select(F.col("src").alias("id"), F.col("dst").alias("component"))
