"""Registered queries over time: as-of values, guarded statuses, free-form
edits and batches that resume from a stored state."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from stockflow import schemas
from stockflow.operators import asof, deletes, history, machine, patches, resume, stock, summaries, supply, trigram
from stockflow.plans import entity_rules
from stockflow.plans.catalog import query
from stockflow.plans.queries import _COMPACT_SQL, _NEED_SQL, _SALES_SUMMARY_SQL, _fulfil_sql, _ledger_sql, _mo_components, _position_all, _sequence_sql
from stockflow.sources.model import (Model, boms, deliver_command, document_patch, layered_bom, line_deliveries, order_command,
                                     receive_command, sales_order_view, status_command, status_events)
from stockflow.session import checkpoint_dir
from stockflow.sources import documents, keyed
from stockflow.stored import store
from stockflow.streaming import folds

# --------------------------------------------------------------------------
# As-of values and stock over time
# --------------------------------------------------------------------------


@query("last_vendor_asof", sql="""
with bought as (
  select product_id, l_shipdate, vendor_id, order_id as purchase_order_id from purchase_line
  qualify row_number() over (partition by product_id, l_shipdate order by order_id desc, line_seq desc) = 1),
sold as (
  select l.order_id, l.line_seq, l.product_id, cast(o.creation_date as timestamp) as created_at
  from sales_line l join sales_order o on o.id = l.order_id)
select s.order_id, s.line_seq, s.product_id, s.created_at, b.vendor_id, b.purchase_order_id
from sold s asof left join bought b on b.product_id = s.product_id and s.created_at >= b.l_shipdate""")
def q_last_vendor_asof(m: Model):
    """C3 as of a time: per sales line, the vendor and order of the product's last purchase when the line was made."""
    made = _created_lines(m).select("order_id", "line_seq", "product_id", "created_at")
    bought = m.purchase_line.select("product_id", "l_shipdate", "vendor_id", F.col("order_id").alias("purchase_order_id"), "line_seq")
    return asof.asof_join(made, bought, ["product_id"], "created_at", "l_shipdate", ["vendor_id", "purchase_order_id"],
                          order=["purchase_order_id", "line_seq"])


def _created_lines(m: Model):
    """Sales lines with the time at which their order was made."""
    made = m.sales_order.select(F.col("id").alias("order_id"), F.col("creation_date").cast("timestamp_ntz").alias("created_at"))
    return m.sales_line.select("order_id", "line_seq", "product_id", "ordered_qty").join(made, "order_id")


def _sales_changes(m: Model):
    return history.reservation_changes(m.sales_line, history.open_switches(status_events(m, "sales")), line_deliveries(m))


# A line reserves from its order's confirmation to its end; c, d, s: the times
# of confirmation, end and delivery, q: what is delivered.
_CHANGES_SQL = """
with span as (
  select l.product_id, l.order_id, l.line_seq, l.ordered_qty as need, l.done_qty as q, l.l_shipdate as s,
         cast(o.creation_date as timestamp) as c,
         case when o.status in ('Fully Delivered', 'Cancelled') then cast(o.due_date as timestamp) end as d
  from sales_line l join sales_order o on o.id = l.order_id where o.status <> 'Draft'),
change as (
  select product_id, c as "at", order_id, line_seq, need - case when s <= c then q else 0 end as qty from span
  union all select product_id, s, order_id, line_seq, -q from span where s > c and (d is null or s <= d)
  union all select product_id, d, order_id, line_seq, -(need - case when s <= d then q else 0 end) from span where d is not null)"""


@query("reservation_changes", sql=_CHANGES_SQL + """
select product_id, "at", order_id, line_seq, cast(qty as decimal(20,3)) as change_qty from change where qty <> 0""")
def q_reservation_changes(m: Model):
    """D1 over time: every change of what a sales line reserves (order opened or closed, delivery)."""
    return _sales_changes(m)


@query("reserved_over_time", sql=_CHANGES_SQL + """
select product_id, "at", cast(sum(sum(qty)) over (partition by product_id order by "at") as decimal(20,3)) as reserved_qty
from change where qty <> 0 group by product_id, "at" """)
def q_reserved_over_time(m: Model):
    """D1 over time: what sales orders reserve per product after each change."""
    return history.reserved_over_time(_sales_changes(m))


_ALL_CHANGES_SQL = _CHANGES_SQL + """,
mo_change as (
  select c.product_id, cast(mo.schedule_date as timestamp) as "at", c.to_consume_qty as qty
  from mo_component c join manufacturing_order mo on mo.id = c.mo_id where mo.status <> 'Draft'
  union all
  select c.product_id, cast(mo.schedule_date as timestamp) + interval 7 day, -c.to_consume_qty
  from mo_component c join manufacturing_order mo on mo.id = c.mo_id where mo.status in ('Done', 'Cancelled')),
level as (
  select product_id, "at", cast(sum(sum(qty)) over (partition by product_id order by "at") as decimal(20,3)) as reserved_qty
  from (select product_id, "at", qty from change where qty <> 0 union all select product_id, "at", qty from mo_change) x
  group by product_id, "at")"""


@query("peak_reserved", sql=_ALL_CHANGES_SQL + """
select product_id, max(reserved_qty) as peak_qty, arg_min("at", (-reserved_qty, "at")) as first_at from level group by product_id""")
def q_peak_reserved(m: Model):
    """D2 over time: the most that sales orders and MOs ever reserved of a product together, and when first."""
    comps = _mo_components(m)
    none = comps.select("mo_id", "product_id", F.lit(None).cast("timestamp_ntz").alias("at"), F.col("consumed_qty").alias("qty")).limit(0)
    made = history.component_reservation_changes(comps, history.open_switches(status_events(m, "manufacturing"), ("Confirmed", "In Progress")), none)
    both = _sales_changes(m).select("product_id", "at", "change_qty").unionByName(made.select("product_id", "at", "change_qty"))
    return history.peak_reserved(history.reserved_over_time(both))


@query("availability_at_creation", sql=_CHANGES_SQL + """,
stream as (
  select product_id, null as "at", 0 as turn, on_hand_qty as moved, null as held, null as order_id, null as line_seq, null as ordered_qty from product
  union all select product_id, movement_date, 2, movement_qty, null, null, null, null from stock_movement
  union all select product_id, "at", 2, null, qty, null, null, null from change
  union all select l.product_id, cast(o.creation_date as timestamp), 1, null, null, l.order_id, l.line_seq, l.ordered_qty
            from sales_line l join sales_order o on o.id = l.order_id),
read as (
  select *, coalesce(sum(moved) over w, 0) as on_hand, coalesce(sum(held) over w, 0) as reserved
  from stream window w as (partition by product_id order by "at" nulls first, turn))
select order_id, line_seq, product_id, ordered_qty, "at" as created_at, cast(on_hand as decimal(20,3)) as on_hand_qty,
       cast(reserved as decimal(20,3)) as reserved_qty,
       case when on_hand - reserved >= ordered_qty then 'Available' else 'Shortage' end as availability
from read where turn = 1""")
def q_availability_at_creation(m: Model):
    """C1 / G11 (snapshot): per sales line, stock and reservations just before it was made, and whether it was available."""
    moves = m.stock_movement.select("product_id", F.col("movement_date").alias("at"), "movement_qty")
    return history.availability_at(_created_lines(m), moves, store(_sales_changes(m), "changes"), m.product.select("product_id", "on_hand_qty"))


# --------------------------------------------------------------------------
# Guarded statuses
# --------------------------------------------------------------------------

# The commands that each status allows, besides 'cancel'.
_OFFERED = {"sales": [("Draft", "confirm"), ("Confirmed", "deliver"), ("Partially Delivered", "deliver")],
            "purchase": [("Draft", "confirm"), ("Confirmed", "receive"), ("Partially Received", "receive")],
            "manufacturing": [("Draft", "confirm"), ("Confirmed", "start"), ("Confirmed", "produce"), ("In Progress", "produce")]}
_MO_COMMANDS_SQL = """
select order_id, seq, command, case command when 'confirm' then 'Confirmed' when 'start' then 'In Progress'
       when 'produce' then 'Done' when 'cancel' then 'Cancelled' end as new_status from status_command"""


def _guarded_sql(kind: str, commands: str) -> str:
    rules = " or ".join(f"(w.status = '{s}' and c.command = '{x}')" for s, x in _OFFERED[kind])
    rules += " or (c.command = 'cancel' and w.status not in ('Fully Delivered', 'Fully Received', 'Done', 'Cancelled'))"
    return f"""
with cmd as (
  select order_id, seq, command, new_status, row_number() over (partition by order_id order by seq) as n from ({commands}) x),
walked as (
  select * from (
    with recursive w as (
      select c.order_id, cast(0 as bigint) as n, cast(null as bigint) as seq, cast(null as varchar) as command, coalesce(o.status, 'Draft') as status,
             cast(null as varchar) as old_status, false as accepted
      from (select distinct order_id from cmd) c left join {kind}_order o on o.id = c.order_id
      union all
      select c.order_id, c.n, c.seq, c.command, case when {rules} then c.new_status else w.status end, w.status, {rules}
      from w join cmd c on c.order_id = w.order_id and c.n = w.n + 1)
    select * from w) y)"""


def _guarded_rows(kind: str, commands: str) -> str:
    return _guarded_sql(kind, commands) + """
select order_id, seq, command, old_status, status as new_status, accepted from walked where n > 0"""


def _commands_of(kind: str, word: str) -> str:
    return f"select order_id, seq, command, new_status from ({_sequence_sql(kind, word)}) s"


@query("guarded_statuses", sql=_guarded_rows("manufacturing", _MO_COMMANDS_SQL))
def q_guarded_statuses(m: Model):
    """E8 / E12 guarded: status commands on MOs, accepted or refused by the status that the accepted ones before led to."""
    return machine.guarded_statuses(m.manufacturing_order.select("id", "status"), status_command(m), "manufacturing")


@query("guarded_statuses_sales", sql=_guarded_rows("sales", _commands_of("sales", "Delivered")))
def q_guarded_statuses_sales(m: Model):
    """E8 / E12 guarded, sales orders: a delivery leads to partial or full delivery."""
    return _guarded(m, "sales")


@query("guarded_statuses_purchase", sql=_guarded_rows("purchase", _commands_of("purchase", "Received")))
def q_guarded_statuses_purchase(m: Model):
    """E8 / E12 guarded, purchase orders."""
    return _guarded(m, "purchase")


def _guarded(m: Model, kind: str):
    orders = m.sales_order if kind == "sales" else m.purchase_order
    return machine.guarded_statuses(orders.select("id", "status"), order_command(m, kind), kind).drop("status")


@query("final_guarded_status", sql=_guarded_sql("sales", _commands_of("sales", "Delivered")) + """
select o.id as order_id, coalesce(w.status, o.status, 'Draft') as status, coalesce(w.accepted, 0) as accepted, coalesce(w.refused, 0) as refused
from sales_order o left join (
  select order_id, arg_max(status, n) as status, count(*) filter (where n > 0 and accepted) as accepted,
         count(*) filter (where n > 0 and not accepted) as refused from walked group by order_id) w on w.order_id = o.id""")
def q_final_guarded_status(m: Model):
    """E8 guarded: every sales order's status when refused commands change nothing, and how many were accepted and refused."""
    return machine.final_guarded_status(m.sales_order.select("id", "status"), _guarded(m, "sales"))


# --------------------------------------------------------------------------
# Free-form edits
# --------------------------------------------------------------------------

# The bodies of document_patch, taken apart into (product_id, seq, field, value).
_SENT_SQL = """
with body as (
  select user_id as product_id, event_id as seq, case event_type
    when 'click' then '{"on_hand_qty":' || cast(cast(floor(value) as bigint) as varchar) || ',"colour":"c' || (event_id % 7) || '"}'
    when 'purchase' then '{"on_hand_qty":null,"sold":' || case when event_id % 2 = 0 then 'true' else 'false' end || '}'
    when 'error' then '{"procurement_type":null,"size":{"h":' || (event_id % 7) || ',"w":[1,"x"]}}'
    when 'signup' then '{"product_name":"renamed ' || event_id || '","colour":null}'
    else '{"reference":"X-' || event_id || '","on_hand_qty":"about ' || (event_id % 7) || '","rank":' || (event_id % 7) || '}' end as body
  from events),
sent as (
  select product_id, seq, field, json_extract(body, '$.' || field) as value
  from (select *, unnest(json_keys(body)) as field from body) k where field <> 'reference'),
last as (
  select product_id, field, max(seq) as seq, arg_max(value, seq) as value from sent group by product_id, field)"""


@query("patch_fields", sql=_SENT_SQL + """
select product_id, field, cast(value as varchar) as value,
       case json_type(value) when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string'
            when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind, seq
from last""")
def q_patch_fields(m: Model):
    """The last value per product and key of edits with any keys, with its JSON type."""
    fields = patches.patch_fields(document_patch(m), "product_id")
    return fields.select("product_id", "field", F.to_json("value").alias("value"), patches.json_type(F.col("value")).alias("kind"), "seq")


@query("overlay_documents", sql=_SENT_SQL + """,
stay as (
  select product_id, '{' || string_agg('"' || field || '":' || cast(value as varchar), ',' order by field) || '}' as extra from last
  where field not in ('product_name', 'on_hand_qty', 'procurement_type') or (field = 'on_hand_qty' and json_type(value) = 'VARCHAR')
  group by product_id)
select p.product_id, p.reference, coalesce(n.value ->> '$', p.product_name) as product_name,
       case when q.value is null then p.on_hand_qty else try_cast(q.value ->> '$' as decimal(14,3)) end as on_hand_qty,
       case when t.value is null then p.procurement_type end as procurement_type, cast(x.extra as varchar) as extra
from product p
left join last n on n.product_id = p.product_id and n.field = 'product_name'
left join last q on q.product_id = p.product_id and q.field = 'on_hand_qty'
left join last t on t.product_id = p.product_id and t.field = 'procurement_type'
left join stay x on x.product_id = p.product_id""")
def q_overlay_documents(m: Model):
    """Products after edits with any keys; unknown keys, and values that don't fit, live on in one VARIANT column."""
    base = m.product.select("product_id", "reference", "product_name", "on_hand_qty", "procurement_type")
    return patches.overlay_documents(base, document_patch(m), "product_id").withColumn("extra", F.to_json("extra"))


# --------------------------------------------------------------------------
# Batches that resume from a stored state
# --------------------------------------------------------------------------

_HALF = "1998-06-01"  # where the test feeds are cut in two


def _halves(df, at: str):
    cut = F.lit(_HALF).cast("timestamp_ntz")
    return df.filter(F.col(at) < cut), df.filter(~F.coalesce(F.col(at) < cut, F.lit(False)))


@query("ledger_resumed", sql="""
select m.product_id, m.movement_date, m.order_id, m.line_seq, m.reference_type, m.movement_qty,
       cast(p.on_hand_qty + sum(m.movement_qty) over (partition by m.product_id
            order by m.movement_date, m.order_id, m.line_seq rows between unbounded preceding and current row)
            as decimal(20,3)) as resulting_on_hand
from stock_movement m left join product p on p.product_id = m.product_id""")
def q_ledger_resumed(m: Model):
    """E1 in two batches: the second reads its own movements and the stored balances only."""
    order = ["movement_date", "order_id", "line_seq"]
    state = resume.opening_state(m.product, m.stock_movement, order)
    rows = []
    for half in _halves(m.stock_movement, "movement_date"):
        batch = resume.ledger_batch(half, state, order)
        state = store(batch.state, "balances")
        rows.append(batch.rows)
    return rows[0].unionByName(rows[1])


def _resumed(m: Model, kind: str):
    """Both halves of the deliveries or receipts: (result, ledger) of each and the last state."""
    orders, lines, commands = ((m.sales_order, m.sales_line, deliver_command(m)) if kind == "sales"
                               else (m.purchase_order, m.purchase_line, receive_command(m)))
    moved = lines.select("product_id", F.col("l_shipdate").alias("cmd_time"), "order_id", "line_seq")
    state = resume.FulfilState(lines.select("order_id", "line_seq", "product_id", "ordered_qty", "done_qty"),
                               resume.opening_state(m.product, moved, ["cmd_time", "order_id", "line_seq"]))
    done = []
    for half in _halves(commands, "cmd_time"):
        result, entries, after = resume.fulfil_batch(kind, orders, state, half, ["cmd_time"])
        done.append((result, entries))
        state = resume.FulfilState(store(after.lines, "lines"), store(after.balances, "balances"))
    return done, state


@query("fulfil_resumed_ledger", sql=_ledger_sql("sales"))
def q_fulfil_resumed_ledger(m: Model):
    """E6 + E1 in two batches: deliveries and their running balance from stored lines and balances."""
    (first, second), _ = _resumed(m, "sales")
    return first[1].rows.unionByName(second[1].rows)


@query("receive_resumed_lines", sql=_fulfil_sql("purchase") + " select * from lines_after")
def q_receive_resumed_lines(m: Model):
    """E6 in two batches: purchase lines after all receipts."""
    return _resumed(m, "purchase")[1].lines


# --------------------------------------------------------------------------
# Deletes with cascades and refusals (H7)
# --------------------------------------------------------------------------


@query("delete_outcomes", sql=entity_rules.deletes_sql())
def q_delete_outcomes(m: Model):
    """H7 with refusal: of many requested deletes in all tables, which rows go, cascade, are refused or kept, and what blocks them."""
    tables = entity_rules.entities(m)
    asked = {t: tables[t].filter(F.expr(rule)) for t, rule in entity_rules.REQUESTED.items()}
    return deletes.delete_outcomes(tables, asked, schemas.CASCADE, schemas.FOREIGN_KEYS)


# --------------------------------------------------------------------------
# Supply over all levels of the BoMs
# --------------------------------------------------------------------------


def _supply_sql(levels: int = 16) -> str:
    """Levels from a recursive walk, then one CTE per level (no more than 16
    halvings of a product's id)."""
    steps = []
    for k in range(levels):
        above = " union all ".join(f"select product_id, net_qty from plan_{j}" for j in range(k)) or "select 0 as product_id, 0 as net_qty where false"
        steps.append(f"""plan_{k} as (
  select n.product_id, n.level, coalesce(d.quantity, 0) as demand_qty, coalesce(u.needed, 0) as needed_qty,
         cast(coalesce(d.quantity, 0) + greatest(coalesce(u.needed, 0) - greatest(coalesce(p.free_qty, 0), 0), 0) as decimal(20,3)) as net_qty
  from level n left join demand d on d.product_id = n.product_id left join position_all p on p.product_id = n.product_id
  left join (select e.part_id, sum(a.net_qty * e.each_qty) as needed from ({above}) a join edge e on e.product_id = a.product_id group by 1) u
    on u.part_id = n.product_id
  where n.level = {k})""")
    every = " union all ".join(f"select * from plan_{k}" for k in range(levels))
    return _NEED_SQL.rstrip() + f""",
demand as (select product_id, sum(quantity) as quantity from need group by product_id),
edge as (
  select product_id, part_id, sum(each_qty) as each_qty from (
    select product_id, x.part_id, cast(x.part_id % 5 + 1 as decimal(20,3)) as each_qty
    from (select product_id, unnest([product_id // 2, product_id // 3]) as part_id from product
          where product_id % 3 = 0 and product_id >= 6 and procure_on_demand and procurement_type = 'Manufacturing') x) y
  group by 1, 2),
level as (select product_id, max(level) as level from (
  with recursive w as (select product_id, 0 as level from demand
                       union select e.part_id, w.level + 1 from w join edge e on e.product_id = w.product_id)
  select * from w) z group by product_id),
{", ".join(steps)},
planned as (
  select a.product_id, a.level, cast(a.demand_qty as decimal(20,3)) as demand_qty, cast(a.needed_qty as decimal(20,3)) as needed_qty, a.net_qty,
         case when a.net_qty > 0 and p.procure_on_demand then p.procurement_type end as supply
  from ({every}) a left join product p on p.product_id = a.product_id)"""


def _supply(m: Model):
    short = stock.shortages(m.sales_order, m.sales_line, m.product).filter("short_qty > 0")
    free = m.product.join(_position_all(m).select("product_id", "free_qty"), "product_id", "left")
    wanted = short.join(m.product.filter("procure_on_demand").select("product_id"), "product_id", "left_semi")
    plan, _ = supply.supply_plan(wanted.select("product_id", F.col("short_qty").alias("quantity")), free, layered_bom(m))
    return plan


@query("supply_plan", sql=_supply_sql() + " select * from planned")
def q_supply_plan(m: Model):
    """K2 on all levels: what shortages, and the needs of what is made for them, raise as purchases and MOs."""
    return _supply(m)


@query("supply_components", sql=_supply_sql() + """
select a.product_id, a.level, e.part_id, cast(a.net_qty * e.qty as decimal(20,3)) as to_consume_qty
from planned a join (select product_id, part_id, cast(part_id % 5 + 1 as decimal(14,3)) as qty
                     from (select product_id, unnest([product_id // 2, product_id // 3]) as part_id from product where product_id >= 6) x) e
  on e.product_id = a.product_id where a.supply = 'Manufacturing'""")
def q_supply_components(m: Model):
    """C6 on all levels: components of all draft MOs of the supply plan."""
    return supply.supply_components(_supply(m), m.product, layered_bom(m))


# --------------------------------------------------------------------------
# Streams as runs of summaries
# --------------------------------------------------------------------------


def _in_batches(m: Model, parts, run):
    """Put each of ``parts`` (frames of one schema) into a feed folder and call
    ``run(stream)`` on it, as a stream that is restarted for each."""
    base = os.path.join(checkpoint_dir(m.spark), "streams", f"feed-{uuid.uuid4().hex[:8]}")
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/feed")
        out = run(m.spark.readStream.schema(part.schema).parquet(f"{base}/feed"), base)
    return out, base


@query("stream_ledger", sql="""
select m.product_id, m.movement_date, m.order_id, m.line_seq, m.reference_type, m.movement_qty,
       cast(p.on_hand_qty + sum(m.movement_qty) over (partition by m.product_id
            order by m.movement_date, m.order_id, m.line_seq rows between unbounded preceding and current row)
            as decimal(20,3)) as resulting_on_hand
from stock_movement m left join product p on p.product_id = m.product_id""")
def q_stream_ledger(m: Model):
    """E1 as a stream: the running balance per movement over three restarted micro-batches."""
    at = F.col("movement_date")
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1999-01-01")]
    parts = [m.stock_movement.filter(c) for c in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1])]
    _, base = _in_batches(m, parts, lambda stream, base: folds.fold_ledger(stream, m.product, ["movement_date", "order_id", "line_seq"], base))
    return folds.read_ledger(m.spark, base).drop("batch")


@query("stream_compact_changes", sql=_COMPACT_SQL)
def q_stream_compact_changes(m: Model):
    """E7 as a stream: live records after five restarted micro-batches, which hold the feed's rows in no order."""
    parts = [m.change_feed.filter(F.col("seq") % 5 == k) for k in (3, 0, 4, 1, 2)]
    runs, _ = _in_batches(m, parts, lambda stream, base: folds.fold_changes(stream, base, "record_id", ["new_value"], ["new_label"]))
    return folds.current_records(runs, "record_id", ["new_value"], ["new_label"])


# --------------------------------------------------------------------------
# Tables stored by a key
# --------------------------------------------------------------------------


@query("sales_order_summary_keyed", sql=_SALES_SUMMARY_SQL)
def q_sales_order_summary_keyed(m: Model):
    """D8 over orders and lines stored by order: joined, and reserved quantities taken, without an exchange on the order."""
    base = os.path.join(checkpoint_dir(m.spark), "keyed", uuid.uuid4().hex)
    buckets = keyed.buckets_for(m.spark, 0)
    orders = keyed.write_keyed(m.sales_order, f"{base}/orders", "id", buckets)
    lines = keyed.write_keyed(m.sales_line, f"{base}/lines", "order_id", buckets)
    reserved = stock.reserved_all(orders, lines, m.manufacturing_order, _mo_components(m))
    return summaries.sales_order_summary(orders, lines, m.product, m.app_user, stock.stock_position(m.product, reserved), keyed=True)


# --------------------------------------------------------------------------
# Indexed search
# --------------------------------------------------------------------------


def _indexed(m: Model, term: str):
    orders, fields = sales_order_view(m), ["reference", "customer_name"]
    path = os.path.join(checkpoint_dir(m.spark), "search", uuid.uuid4().hex)
    trigram.build_index(orders, "id", fields, path)
    return trigram.search_index(orders, path, "id", fields, term).select("id", "reference", "customer_name", "status")


_FOUND_SQL = """
select id, reference, customer_name, status from sales_order_view
where coalesce(contains(lower(reference), '{0}'), false) or coalesce(contains(lower(customer_name), '{0}'), false)"""


@query("search_indexed", sql=_FOUND_SQL.format("r#0000"))
def q_search_indexed(m: Model):
    """B5 by trigrams: sales orders with 'R#0000' in reference or customer, from the index's shortest lists."""
    return _indexed(m, "R#0000")


@query("search_indexed_short", sql=_FOUND_SQL.format("77"))
def q_search_indexed_short(m: Model):
    """B5 by trigrams: a term shorter than a trigram, from all grams that contain it."""
    return _indexed(m, "77")


# --------------------------------------------------------------------------
# Contents of stored documents (A4, A5)
# --------------------------------------------------------------------------


@query("snapshot_permissions", sql="select cast(user_id as bigint) as user_id, module, can_view from permission")
def q_snapshot_permissions(m: Model):
    """A4 + A1: the permission half of a snapshot that replaced another one."""
    path = os.path.join(checkpoint_dir(m.spark), "snapshots", uuid.uuid4().hex)
    documents.write_snapshot(m.app_user, m.permission.filter("module = 'Sales'"), path)
    documents.write_snapshot(m.app_user, m.permission, path)
    return documents.read_snapshot(m.spark, path)[1].select("user_id", "module", "can_view")


@query("summary_json_lines", sql="""
select b.id, p.product_name, bc.component_product_id, cp.product_name as component_name, bc.to_consume_qty
from bom b join product p on p.product_id = b.finished_product_id
join bom_component bc on bc.bom_id = b.id left join product cp on cp.product_id = bc.component_product_id""")
def q_summary_json_lines(m: Model):
    """A5: what nested BoM documents, written as JSON lines, hold when read back, by component."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    path = os.path.join(checkpoint_dir(m.spark), "summaries", uuid.uuid4().hex)
    documents.write_summary_json(doc, path)
    back = m.spark.read.schema(doc.schema).json(path)
    return back.select("id", F.col("finished_product_name").alias("product_name"), F.inline("components"))
