"""Fulfilment from quantity commands.

The reference applies each command line by line:
    delta = min(request, ordered) - done;  if delta > 0: done += delta
which is  done <- max(done, min(request, ordered)).  After command k,
    done_k = greatest(initial, max_{i<=k} least(request_i, ordered)),
an ordered prefix max: associative, so it runs as a piecewise scan (hot
lines are split) with no UDF and no state store. The movement at k is
done_k - done_{k-1} when positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.scan import prefix_scan
from stockflow.stored import store
from stockflow.types import QTY_SUM


# Fixed values per kind of order: the word of its done statuses, the audit
# module and record type, and the sign of its movements.
_DONE_WORD = {"sales": "Delivered", "purchase": "Received"}
_AUDIT = {"sales": ("Sales", "SalesOrder"), "purchase": ("Purchase", "PurchaseOrder")}
_SIGN = {"sales": -1, "purchase": 1}


def _request(col: str, need: Column, fallback_to_need: bool) -> Column:
    # NaN is falsy in JavaScript; Spark's max / greatest would keep it.
    r = F.when(F.isnan(F.col(col).cast("double")), F.lit(None)).otherwise(F.col(col))
    if fallback_to_need:
        # `x || need`: null, 0 and NaN fall back to the full need.
        return F.when(r.isNull() | (r == 0), need).otherwise(r)
    # `x || 0`
    return F.coalesce(r, F.lit(0))


def apply_quantity_commands(commands: DataFrame, keys: Sequence[str], order: Sequence[str],
                            need_col: str = "ordered_qty", initial_col: str | None = "done_qty",
                            request_col: str = "requested_qty", fallback_to_need: bool = False, settle: bool = False,
                            sizes: DataFrame | None = None) -> DataFrame:
    """Per command row: done_before, done_after and delta (>= 0).

    ``commands`` carries the target's need (and initial done, if any) per
    row, e.g. after joining commands to their lines. Ties in ``order`` must
    not occur: the order is the arrival order of commands and lines.
    ``settle``, ``sizes``: see ``prefix_scans``.
    """
    need = F.coalesce(F.col(need_col), F.lit(0))
    initial = F.coalesce(F.col(initial_col), F.lit(0)) if initial_col else F.lit(0)
    capped = F.least(_request(request_col, need, fallback_to_need), need)
    c = commands.withColumn("_capped", capped)
    c = prefix_scan(c, keys, order, "_capped", "max", "_prior", inclusive=False, settle=settle, sizes=sizes)
    before = F.greatest(initial, F.coalesce(F.col("_prior"), initial))
    c = (c.withColumn("done_before", before.cast(QTY_SUM))
         .withColumn("done_after", F.greatest(F.col("done_before"), F.col("_capped")).cast(QTY_SUM))
         .withColumn("delta", (F.col("done_after") - F.col("done_before")).cast(QTY_SUM))
         .drop("_capped", "_prior"))
    return c


def _movements(applied: DataFrame, sign: int, cols: Sequence[str]) -> DataFrame:
    return (applied.filter(F.col("delta") > 0)
            .select(*cols, "done_after", (F.col("delta") * sign).cast(QTY_SUM).alias("movement_qty")))


def apply_deliveries(commands: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """Delivery movements (negative) per command line that raised delivered."""
    a = apply_quantity_commands(commands, keys, order, **kw)
    return _movements(a, -1, list(keys) + [c for c in order if c not in keys])


def apply_receipts(commands: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """Receipt movements (positive)."""
    a = apply_quantity_commands(commands, keys, order, **kw)
    return _movements(a, 1, list(keys) + [c for c in order if c not in keys])


def apply_consumption(commands: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """Component consumption (negative); a 0/null request means the full
    remaining need."""
    a = apply_quantity_commands(commands, keys, order, fallback_to_need=True, **kw)
    return _movements(a, -1, list(keys) + [c for c in order if c not in keys])


def finished_movements(produce_commands: DataFrame, mos: DataFrame) -> DataFrame:
    """E5: +quantity of the finished product for every produce command, even
    repeated ones."""
    m = mos.select(F.col("id").alias("mo_id"), F.col("finished_product_id").alias("product_id"),
                   "quantity")
    return (produce_commands.join(m, "mo_id")
            .select("mo_id", "seq", "product_id", F.col("quantity").cast(QTY_SUM).alias("movement_qty")))


def completion_status(orders: DataFrame, lines: DataFrame, kind: str = "sales") -> DataFrame:
    """D13: 'Fully <x>' when every line has done >= ordered (also when the
    order has no lines), else 'Partially <x>'."""
    word = _DONE_WORD[kind]
    per = lines.groupBy("order_id").agg(
        F.every(F.coalesce(F.col("done_qty"), F.lit(0)) >= F.col("ordered_qty")).alias("_all"))
    return (orders.select(F.col("id").alias("order_id")).join(per, "order_id", "left")
            .select("order_id", F.when(F.coalesce("_all", F.lit(True)), F.lit(f"Fully {word}"))
                    .otherwise(F.lit(f"Partially {word}")).alias("status")))


def request_status(lines: DataFrame, applied: DataFrame, request: Sequence[str],
                   kind: str = "sales", requests: DataFrame | None = None) -> DataFrame:
    """Status of each order right after each of its requests (D13 as of then).

    A request is a group of command rows with the same (order_id, *request)
    columns; ``requests`` (order_id, *request) adds those that name no line.
    The order is complete after request r exactly when its lines that were
    initially incomplete minus the lines completed by requests up to r is
    zero (so an order without lines always is). A line completes at the
    command whose done_before < ordered <= done_after, so the status is a
    prefix sum of completions per order (hot orders are split): no line is
    paired with any request.
    """
    word = _DONE_WORD[kind]
    request = list(request)
    done0 = F.coalesce(F.col("done_qty"), F.lit(0))
    incomplete = (lines.groupBy("order_id")
                  .agg(F.count_if(done0 < F.col("ordered_qty")).alias("_incomplete")))
    completed = (F.col("done_before") < F.col("ordered_qty")) & (F.col("done_after") >= F.col("ordered_qty"))
    rows = applied.select("order_id", *request, completed.cast("long").alias("_done"))
    if requests is not None:
        rows = rows.unionByName(requests.select("order_id", *request, F.lit(0).cast("long").alias("_done")))
    per_req = rows.groupBy("order_id", *request).agg(F.coalesce(F.sum("_done"), F.lit(0)).alias("_done_lines"))
    cum = prefix_scan(per_req, ["order_id"], request, "_done_lines", "sum", "_cum", settle=True, sizes=per_req if requests is None else applied)
    left = F.coalesce(F.col("_incomplete"), F.lit(0)) - F.col("_cum")
    return (cum.join(incomplete, "order_id", "left")
            .select("order_id", *request,
                    F.when(left <= 0, F.lit(f"Fully {word}")).otherwise(F.lit(f"Partially {word}")).alias("status")))


class FulfilResult:
    """Outputs of ``fulfil_orders``, each built on first access (so asking
    for ``status`` alone runs none of the ordered scans). Dict-style access
    (``result["status"]``) works too."""

    _NAMES = ("lines", "movements", "status", "audit", "ledger", "rejects")

    def __init__(self, kind, orders, lines, commands, order, opening, requests):
        self._kind, self._extra_requests = kind, requests
        self._orders, self._lines, self._commands = orders, lines, commands
        self._order, self._opening = list(order), opening
        self._keys = ["order_id", "line_seq"]
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._NAMES:
            raise KeyError(name)
        if name not in self._cache:
            self._cache[name] = getattr(self, f"_build_{name}")()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._NAMES:
            raise AttributeError(name)
        return self[name]

    def keys(self):
        return [n for n in self._NAMES if n != "ledger" or self._opening is not None]

    def _extra_order(self) -> list[str]:
        return [c for c in self._order if c not in self._keys]

    def _targets(self) -> DataFrame:
        return self._lines.select(*self._keys, "product_id", "ordered_qty", "done_qty")

    def _applied(self) -> DataFrame:
        if "_applied" not in self._cache:
            found = self._commands.join(self._targets(), self._keys)
            # Written once: movements, audit and ledger all read it. The scan
            # goes on from the join's own partitions, so commands tell the hot lines.
            self._cache["_applied"] = store(apply_quantity_commands(found, self._keys, self._order, settle=True, sizes=self._commands), "applied")
        return self._cache["_applied"]

    def _build_rejects(self) -> DataFrame:
        return self._commands.join(self._targets().select(*self._keys), self._keys, "left_anti")

    def _build_movements(self) -> DataFrame:
        return (self._applied().filter(F.col("delta") > 0)
                .select(*self._keys, "product_id", *self._extra_order(),
                        (F.col("delta") * _SIGN[self._kind]).cast(QTY_SUM).alias("movement_qty")))

    def _requests(self) -> DataFrame:
        """Every request on a known order, those without lines included."""
        cols = ["order_id", *self._extra_order()]
        named = self._commands.select(*cols)
        if self._extra_requests is not None:
            named = named.unionByName(self._extra_requests.select(*cols))
        known = self._orders.select(F.col("id").alias("order_id"))
        return named.distinct().join(known, "order_id", "left_semi")

    def _per_line(self) -> DataFrame:
        keys = self._keys
        cmd = self._commands.select(*keys, "requested_qty", F.lit(True).alias("_cmd"))
        need = F.coalesce(F.col("ordered_qty"), F.lit(0))
        capped = F.when(F.col("_cmd"), F.least(_request("requested_qty", need, False), need))
        per_line = (self._lines.join(cmd, keys, "left").groupBy(*keys)
                    .agg(F.first("product_id").alias("product_id"), F.first("ordered_qty").alias("ordered_qty"),
                         F.first("done_qty").alias("_done"), F.max(capped).alias("_max")))
        after = F.when(F.col("_max").isNull(), F.col("_done")).otherwise(
            F.greatest(F.coalesce(F.col("_done"), F.lit(0)), F.col("_max")))
        return per_line.select(*keys, "product_id", "ordered_qty", after.cast(QTY_SUM).alias("done_qty"))

    def _build_lines(self) -> DataFrame:
        return self._per_line()

    def _build_status(self) -> DataFrame:
        asked = self._requests().select(F.col("order_id").alias("id")).distinct()
        return completion_status(asked, self._per_line(), self._kind)

    def _build_audit(self) -> DataFrame:
        req = request_status(self._targets(), self._applied(), self._extra_order(), self._kind, self._requests())
        known = self._orders.select(F.col("id").alias("order_id"))
        module, record = _AUDIT[self._kind]
        return req.join(known, "order_id", "left_semi").select(
            "order_id", *self._extra_order(), F.lit(module).alias("module"), F.lit(record).alias("record_type"),
            F.lit("Updated").alias("action"), F.lit("status").alias("field_changed"),
            F.lit("").alias("old_value"), F.col("status").alias("new_value"))

    def _build_ledger(self) -> DataFrame:
        if self._opening is None:
            raise KeyError("ledger needs opening balances")
        from stockflow.operators.ledger import ledger
        return ledger(self["movements"], self._opening, self._order + self._keys)


def fulfil_orders(kind: str, orders: DataFrame, lines: DataFrame, commands: DataFrame,
                  order: Sequence[str], opening: DataFrame | None = None,
                  requests: DataFrame | None = None) -> FulfilResult:
    """Deliver commands on sales lines (kind 'sales') or receive commands
    on purchase lines (kind 'purchase').

    commands(order_id, line_seq, requested_qty, <order columns>) against
    lines(order_id, line_seq, product_id, ordered_qty, done_qty).
    ``requests`` (order_id, <order columns>) adds requests that name no line:
    they move nothing but set the status and write an audit row. Returns a
    FulfilResult whose frames are built on first use:

    - movements: one movement per command that raised the done quantity,
      negative for deliveries (ordered prefix max per line; hot lines are split);
    - lines: every line with its done quantity after all commands;
    - status: D13 status of every order that received a request;
    - audit: one row per request (order_id, *order) with the status right
      after it, as the reference writes (old value '');
    - ledger: movements with the running on-hand (E1), when ``opening``
      (product_id, on_hand_qty) is given;
    - rejects: commands for a line that does not exist.

    The final line state needs no ordering: done after = greatest(initial,
    max over the line's commands of least(request, ordered)), so lines and
    status are two aggregates (partial aggregation handles hot lines and
    orders) over lines left-joined to their commands.
    """
    return FulfilResult(kind, orders, lines, commands, order, opening, requests)


def fulfil_sales(orders: DataFrame, lines: DataFrame, commands: DataFrame, order: Sequence[str],
                 opening: DataFrame | None = None, requests: DataFrame | None = None) -> FulfilResult:
    """E6 for sales orders (see ``fulfil_orders``)."""
    return fulfil_orders("sales", orders, lines, commands, order, opening, requests)


def fulfil_purchases(orders: DataFrame, lines: DataFrame, commands: DataFrame, order: Sequence[str],
                     opening: DataFrame | None = None, requests: DataFrame | None = None) -> FulfilResult:
    """E6 for purchase orders (see ``fulfil_orders``)."""
    return fulfil_orders("purchase", orders, lines, commands, order, opening, requests)


def produce_orders(mos: DataFrame, components: DataFrame, explicit: DataFrame, produce: DataFrame,
                   opening: DataFrame | None = None) -> dict[str, DataFrame]:
    """E4 + E5 + E6 for manufacturing: produce requests on MOs.

    components(mo_id, product_id, to_consume_qty, consumed_qty);
    explicit(mo_id, product_id, seq, requested_qty): component lines sent
    with a produce request (0/null = the full need);
    produce(mo_id, seq): every produce request, with or without a list;
    ``produce.all_components`` (boolean, default true when the column is
    absent) marks requests sent without a component list.

    A request without a list reads each component's current consumption
    as its request: untouched components are consumed in full, partly
    consumed ones not at all. Only the MO's first such request can
    consume anything (after it every component's consumption is above
    zero), so it becomes one event per component. It is never expanded
    per request, so no request x component pairs are formed. It takes
    effect only if no earlier event of that component was positive. That
    is one exclusive prefix max to decide, and a second for consumed-
    before; both are associative.

    Returns consumption (negative) and finished (positive, one per request,
    E5) movements, their union, components after, status 'Done' for every
    produced MO, audit rows, and the ledger when ``opening`` is given.
    """
    keys = ["mo_id", "product_id"]
    comp = components.select(*keys, F.col("to_consume_qty").alias("_need"),
                             F.coalesce(F.col("consumed_qty"), F.lit(0)).alias("_init"))
    ex = (explicit.join(comp, keys)
          .select(*keys, "seq", F.lit(False).alias("_synth"),
                  F.least(_request("requested_qty", F.col("_need"), True), F.col("_need")).alias("_t"),
                  "_need", "_init"))
    all_flag = F.col("all_components") if "all_components" in produce.columns else F.lit(True)
    first_all = (produce.filter(F.coalesce(all_flag, F.lit(False)))
                 .groupBy("mo_id").agg(F.min("seq").alias("seq")))
    synth = (first_all.join(comp, "mo_id")
             .select(*keys, "seq", F.lit(True).alias("_synth"), F.col("_need").alias("_t"), "_need", "_init"))
    ev = store(ex.unionByName(synth), "events")  # counted once for both scans
    order = ["seq", "_synth"]
    sizes = ev
    ev = prefix_scan(ev, keys, order, "_t", "max", "_pt", inclusive=False, settle=True, sizes=sizes)
    eff = F.when(~F.col("_synth"), F.col("_t")).when(
        (F.coalesce(F.col("_pt"), F.lit(0)) <= 0) & (F.col("_init") == 0), F.col("_need")).otherwise(F.lit(0))
    ev = ev.withColumn("_eff", eff)
    ev = prefix_scan(ev, keys, order, "_eff", "max", "_pe", inclusive=False, settle=True, sizes=sizes)
    before = F.greatest(F.col("_init"), F.coalesce(F.col("_pe"), F.col("_init")))
    ev = (ev.withColumn("_before", before)
          .withColumn("_after", F.greatest(F.col("_before"), F.col("_eff")))
          .withColumn("_delta", F.col("_after") - F.col("_before")))
    ev = store(ev, "consumed")  # movements and components read it
    consumption = (ev.filter(F.col("_delta") > 0)
                   .select("mo_id", "product_id", "seq", (-F.col("_delta")).cast(QTY_SUM).alias("movement_qty")))
    finished = finished_movements(produce.select("mo_id", "seq"), mos)
    movements = (consumption.withColumn("kind", F.lit("consume"))
                 .unionByName(finished.withColumn("kind", F.lit("finish"))))
    after = ev.groupBy(*keys).agg(F.max("_after").alias("_max"))
    comps_after = (components.join(after, keys, "left")
                   .withColumn("consumed_qty", F.coalesce(F.col("_max"), F.coalesce(F.col("consumed_qty"), F.lit(0)))
                               .cast(QTY_SUM)).drop("_max"))
    produced = produce.select("mo_id").distinct()
    status = produced.select(F.col("mo_id"), F.lit("Done").alias("status"))
    audit = produce.select("mo_id", "seq", F.lit("Manufacturing").alias("module"),
                           F.lit("ManufacturingOrder").alias("record_type"), F.lit("Updated").alias("action"),
                           F.lit("status").alias("field_changed"), F.lit("").alias("old_value"),
                           F.lit("Done").alias("new_value"))
    out = {"consumption": consumption, "finished": finished, "movements": movements,
           "components": comps_after, "status": status, "audit": audit}
    if opening is not None:
        from stockflow.operators.ledger import ledger
        out["ledger"] = ledger(movements.select("product_id", "mo_id", "seq", "kind", "movement_qty"), opening,
                               ["seq", "mo_id", "kind"])
    return out


# E6 under the inventory's name.
fulfil = fulfil_orders
