"""Ledger and fulfilment in batches, each starting from a stored state.

A state holds what an ordered scan carries: per product its balance and the
last movement it has seen, per line what is done. A batch reads its own events
and the state, never earlier events, and gives its rows and the next state.
Batches of any sizes give the rows of one run over all events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact
from stockflow.operators.fulfil import FulfilResult, fulfil_orders, produce_orders
from stockflow.operators.scan import prefix_scans, scan_carry, split_late
from stockflow.stored import store
from stockflow.types import QTY_SUM


@dataclass(frozen=True)
class LedgerBatch:
    """``rows``: the batch's ledger; ``state``: what the next one starts from;
    ``late``: movements at or before the last one that their product has had,
    which change neither."""

    rows: DataFrame
    state: DataFrame
    late: DataFrame


def opening_state(opening: DataFrame, movements: DataFrame, order: Sequence[str]) -> DataFrame:
    """The state before any movement: (product_id, resulting_on_hand, through);
    ``movements`` gives the order columns' types only."""
    none = F.lit(None).cast(movements.select(F.struct(*order)).schema[0].dataType)
    return opening.select("product_id", exact("on_hand_qty").alias("resulting_on_hand"), none.alias("through"))


def ledger_batch(movements: DataFrame, state: DataFrame, order: Sequence[str]) -> LedgerBatch:
    """E1 for one batch: movements(product_id, movement_qty, <order>) with
    their resulting_on_hand, from the balances in ``state``. Hot products are
    split; the state meets one row per product and piece."""
    on_time, late = split_late(movements, ["product_id"], order, state)
    on_time = store(on_time, "on_time")
    specs = [(exact("movement_qty"), "sum", "resulting_on_hand")]
    rows = prefix_scans(on_time, ["product_id"], order, specs, carry=state, settle=True, sizes=on_time)
    after = scan_carry(on_time, ["product_id"], order, specs, carry=state)
    return LedgerBatch(rows.withColumn("resulting_on_hand", F.col("resulting_on_hand").cast(QTY_SUM)),
                       after.withColumn("resulting_on_hand", exact("resulting_on_hand")), late)


@dataclass(frozen=True)
class FulfilState:
    """``lines`` (order_id, line_seq, product_id, ordered_qty, done_qty) and
    the ledger state."""

    lines: DataFrame
    balances: DataFrame


def fulfil_batch(kind: str, orders: DataFrame, state: FulfilState, commands: DataFrame, order: Sequence[str],
                 requests: DataFrame | None = None) -> tuple[FulfilResult, LedgerBatch, FulfilState]:
    """E6 for one batch of commands: its result (movements, status, audit,
    rejects), its ledger and the next state. What earlier batches delivered is
    in the state's lines, which is all that a capped command depends on."""
    result = fulfil_orders(kind, orders, state.lines, commands, order, requests=requests)
    entries = ledger_batch(result.movements, state.balances, [*order, "order_id", "line_seq"])
    return result, entries, FulfilState(result.lines, entries.state)


def produce_batch(mos: DataFrame, components: DataFrame, explicit: DataFrame, produce: DataFrame,
                  balances: DataFrame) -> tuple[dict[str, DataFrame], LedgerBatch]:
    """E4-E6 for one batch of produce requests; ``result["components"]`` and
    the ledger's state are what the next batch starts from."""
    result = produce_orders(mos, components, explicit, produce)
    movements = result["movements"].select("product_id", "mo_id", "seq", "kind", "movement_qty")
    return result, ledger_batch(movements, balances, ["seq", "mo_id", "kind"])
