"""Reachability by a frontier: each round joins the newest nodes only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.stored import store


def reached(seeds: DataFrame, edges: DataFrame | None, node: Sequence[str], to: Sequence[str], most: int | None = None) -> DataFrame:
    """Nodes (columns ``node``) reachable from ``seeds`` along ``edges``
    (columns ``node`` and ``to``), the seeds included. Rounds follow the
    longest shortest path; cycles end by themselves. ``most``: the longest
    path that there can be, if known, after which no further round looks."""
    node = list(node)
    found = frontier = store(seeds.select(*node).distinct(), "reached")
    rounds = 0
    while edges is not None and (most is None or rounds < most):
        ahead = (edges.join(frontier, node, "left_semi").select(*[F.col(t).alias(n) for n, t in zip(node, to)]).distinct()
                 .join(found, node, "left_anti"))
        frontier = store(ahead, "reached")
        if frontier.isEmpty():
            break
        rounds += 1
        found = found.unionByName(frontier)
        if rounds % 8 == 0:  # keeps the plan short
            found = store(found, "reached")
    return found
