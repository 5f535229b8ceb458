"""As-of joins: each row takes the last value known at its time.

Both sides become one stream ordered by key and time, and the right side's
last row is carried forward by the piecewise scan. So a key with any share of
the rows is dealt to as many tasks as its volume needs, and no row is paired
with more than one other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.scan import prefix_scan


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              values: Sequence[str], order: Sequence[str] = (), strict: bool = False,
              within: Column | None = None) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of the same keys at
    or before the left row's time (``strict``: before it). Rows of ``right``
    at one time follow each other by ``order``, then by a hash.

    ``within`` drops a match that is older than this interval. A left row
    without a match, or with a null time, gets nulls; a right row with a null
    time never matches. Null keys meet null keys. A value that is null on the
    matching row stays null: it is not looked for in older rows.
    """
    keys, values, order = list(keys), list(values), list(order)
    kept = [c for c in left.columns if c not in values]
    l_rows = left.select(
        F.struct(*[left[c] for c in kept]).alias("_left"), *[left[k] for k in keys], left[left_time].alias("_at"),
        F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(F.struct(*order)).schema[0].dataType).alias("_order") if order else F.lit(None).cast("int").alias("_order"),
        F.lit(None).cast(right.select(F.struct(F.col(right_time).alias("at"), *values)).schema[0].dataType).alias("_right"))
    r_rows = right.filter(F.col(right_time).isNotNull()).select(
        F.lit(None).cast(l_rows.schema["_left"].dataType).alias("_left"), *[right[k] for k in keys], right[right_time].alias("_at"),
        F.lit(1 if strict else 0).alias("_side"), (F.struct(*order) if order else F.lit(None).cast("int")).alias("_order"),
        F.struct(F.col(right_time).alias("at"), *values).alias("_right"))
    merged = prefix_scan(l_rows.unionByName(r_rows), keys, ["_at", "_side", "_order"], "_right", "last", "_match", settle=True)
    known = F.col("_at").isNotNull()
    if within is not None:
        known = known & (F.col("_match.at") + within >= F.col("_at"))
    return (merged.filter(F.col("_left").isNotNull())
            .select("_left.*", *[F.when(known, F.col(f"_match.{v}")).alias(v) for v in values]))
