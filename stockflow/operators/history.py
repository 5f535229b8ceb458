"""Stock over time: when orders were open, what they reserved at each moment,
and what a line could have when it was created (C1, D1, D2, G11).

Inputs:
  status_events(order_id, at, status), deliveries(order_id, line_seq, at, qty),
  lines(order_id, line_seq, product_id, ordered_qty),
  movements(product_id, at, movement_qty), opening(product_id, on_hand_qty)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.scalars import availability, exact
from stockflow.operators.scan import prefix_scan, prefix_scans
from stockflow.types import OPEN_SALES, QTY_SUM


def open_switches(status_events: DataFrame, open_statuses: Sequence[str] = OPEN_SALES,
                  order: Sequence[str] = ("at",)) -> DataFrame:
    """(order_id, at, open): the moments at which an order starts or stops
    reserving. An order is closed before its first event; events that leave it
    open, or closed, give no row."""
    now = F.coalesce(F.col("status").isin(*open_statuses), F.lit(False))
    rows = prefix_scan(status_events.withColumn("open", now), ["order_id"], list(order), "open", "last", "_before", inclusive=False, settle=True)
    return rows.filter(F.col("open") != F.coalesce("_before", F.lit(False))).select("order_id", "at", "open")


def reservation_changes(lines: DataFrame, switches: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(product_id, at, order_id, line_seq, change_qty): every change of what a
    line reserves, which is max(0, ordered - delivered) while its order is
    open and nothing otherwise.

    A line's deliveries and its order's switches are merged in time and
    scanned once, with the delivered quantity and the open flag carried
    forward. Rows follow the deliveries plus the lines per switch.
    """
    line = ["order_id", "line_seq"]
    need = lines.select(*line, "product_id", F.coalesce("ordered_qty", F.lit(0)).cast(QTY_SUM).alias("_need"))
    done = (deliveries.select(*line, "at", F.coalesce("qty", F.lit(0)).cast(QTY_SUM).alias("_qty"), F.lit(None).cast("boolean").alias("_open"))
            .join(need, line))
    turned = switches.join(need, "order_id").select(*line, "at", F.lit(0).cast(QTY_SUM).alias("_qty"), F.col("open").alias("_open"), "product_id", "_need")
    # At one moment deliveries come before switches.
    events = done.unionByName(turned).withColumn("_turn", F.col("_open").isNotNull().cast("int"))
    run = prefix_scans(events, line, ["at", "_turn", "_open"], [(exact("_qty"), "sum", "_done"), ("_open", "last", "_now")], settle=True)
    now = F.coalesce("_now", F.lit(False))
    before = F.when(F.col("_open").isNotNull(), ~F.col("_open")).otherwise(now)

    def outstanding(is_open, delivered):
        return F.when(is_open, F.greatest(F.col("_need") - delivered, F.lit(0))).otherwise(F.lit(0))

    change = outstanding(now, F.col("_done")) - outstanding(before, F.col("_done") - F.col("_qty"))
    return (run.select("product_id", "at", *line, change.cast(QTY_SUM).alias("change_qty"))
            .filter(F.col("change_qty") != 0))


def component_reservation_changes(components: DataFrame, switches: DataFrame, consumption: DataFrame) -> DataFrame:
    """The same for the components of manufacturing orders: components(mo_id,
    product_id, to_consume_qty), switches(order_id = mo_id, at, open),
    consumption(mo_id, product_id, at, qty)."""
    lines = components.select(F.col("mo_id").alias("order_id"), F.col("product_id").alias("line_seq"), "product_id",
                              F.col("to_consume_qty").alias("ordered_qty"))
    used = consumption.select(F.col("mo_id").alias("order_id"), F.col("product_id").alias("line_seq"), "at", "qty")
    return (reservation_changes(lines, switches, used)
            .select("product_id", "at", F.col("order_id").alias("mo_id"), "change_qty"))


def reserved_over_time(changes: DataFrame) -> DataFrame:
    """(product_id, at, reserved_qty): what is reserved after each moment with
    a change. A sweep over opening and closing events: changes of one moment
    are added up first (map-side), then summed along the product's time."""
    per = changes.groupBy("product_id", "at").agg(F.sum(exact("change_qty")).cast(QTY_SUM).alias("change_qty"))
    run = prefix_scan(per, ["product_id"], ["at"], exact("change_qty"), "sum", "reserved_qty", settle=True)
    return run.select("product_id", "at", F.col("reserved_qty").cast(QTY_SUM).alias("reserved_qty"))


def peak_reserved(over_time: DataFrame) -> DataFrame:
    """(product_id, peak_qty, first_at): the most that was ever reserved, and
    the first moment at which it was."""
    return over_time.groupBy("product_id").agg(
        F.max("reserved_qty").alias("peak_qty"),
        F.min_by("at", F.struct(-F.col("reserved_qty"), F.col("at"))).alias("first_at"))


def availability_at(lines: DataFrame, movements: DataFrame, changes: DataFrame, opening: DataFrame, at: str = "created_at",
                    need: str = "ordered_qty") -> DataFrame:
    """``lines`` (with their creation time ``at``) plus on_hand_qty,
    reserved_qty and availability as they were just before the line: stock
    movements and reservation changes of its product strictly before ``at``.

    One scan over the three streams: movements and changes are summed along
    the product's time and the lines read the sums on their way, so no line
    is joined to a product and no task holds a product. A line of a product
    without an opening balance starts from nothing; a null time reads the
    opening balance alone.
    """
    taken = ("on_hand_qty", "reserved_qty", "availability")
    none = F.lit(None).cast(QTY_SUM)
    kind = movements.schema["at"].dataType
    rows = lines.select("product_id", F.col(at).cast(kind).alias("_at"), F.lit(1).alias("_turn"), none.alias("_moved"), none.alias("_held"),
                        F.struct(*[lines[c] for c in lines.columns if c not in taken]).alias("_line"))
    blank = F.lit(None).cast(rows.schema["_line"].dataType).alias("_line")
    first = F.lit(None).cast(kind).alias("_at")  # null times sort first

    def stream(df, time, moved, held, turn):
        return df.select("product_id", time, F.lit(turn).alias("_turn"), moved.cast(QTY_SUM).alias("_moved"), held.cast(QTY_SUM).alias("_held"), blank)

    events = (rows
              .unionByName(stream(opening, first, F.col("on_hand_qty"), none, 0))
              .unionByName(stream(movements.filter(F.col("at").isNotNull()), F.col("at").alias("_at"), F.col("movement_qty"), none, 2))
              .unionByName(stream(changes.filter(F.col("at").isNotNull()), F.col("at").cast(kind).alias("_at"), none, F.col("change_qty"), 2)))
    run = prefix_scans(events, ["product_id"], ["_at", "_turn"], [(exact("_moved"), "sum", "_on_hand"), (exact("_held"), "sum", "_reserved")], settle=True)
    out = run.filter(F.col("_line").isNotNull()).select(
        "_line.*", F.coalesce("_on_hand", F.lit(0)).cast(QTY_SUM).alias("on_hand_qty"), F.coalesce("_reserved", F.lit(0)).cast(QTY_SUM).alias("reserved_qty"))
    return out.withColumn("availability", availability(need, "on_hand_qty", "reserved_qty", "snapshot"))
