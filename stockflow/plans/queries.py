"""The registered queries over the test-data model, with oracle SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from stockflow.functions.scalars import contains_ci
from stockflow.operators import (access, audit, boards, bom, changes, fulfil, ledger, lines, quality,
                                 search, stock, summaries)
from stockflow.plans import entity_rules, procurement
from stockflow.session import checkpoint_dir
from stockflow.sources import documents
from stockflow.streaming import folds, streams
from stockflow.plans.catalog import query
from stockflow.sources.model import (AS_OF, Model, audit_stream, boms, read_stream, consume_command, deliver_command,
                                     empty_requests, order_command, receive_command,
                                     produce_requests, product_patch, receipt_command, sales_order_view,
                                     saved_permissions,
                                     saved_users, status_command)
from stockflow.types import OPEN_MO

# --------------------------------------------------------------------------
# Stock (D1-D3, C10, G11, K1)
# --------------------------------------------------------------------------


@query("stock_position", sql="""
select p.product_id,
       cast(p.on_hand_qty as decimal(20,3)) as on_hand_qty,
       cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty,
       cast(p.on_hand_qty - coalesce(r.reserved_qty, 0) as decimal(20,3)) as free_qty,
       coalesce(r.open_lines, 0) as open_lines,
       coalesce(s.shortage_lines, 0) as shortage_lines
from product p
left join (select l.product_id, sum(greatest(l.ordered_qty - l.done_qty, 0)) as reserved_qty,
                  count(*) as open_lines
           from sales_line l join sales_order o on o.id = l.order_id
           where o.status in ('Confirmed', 'Partially Delivered') group by l.product_id) r
  on r.product_id = p.product_id
left join (select l.product_id, count(*) as shortage_lines
           from sales_line l join sales_order o on o.id = l.order_id
           join product p2 on p2.product_id = l.product_id
           where o.status in ('Confirmed', 'Partially Delivered')
             and l.ordered_qty > p2.on_hand_qty - (
                 select sum(greatest(l2.ordered_qty - l2.done_qty, 0)) from sales_line l2
                 join sales_order o2 on o2.id = l2.order_id
                 where o2.status in ('Confirmed', 'Partially Delivered') and l2.product_id = l.product_id)
           group by l.product_id) s
  on s.product_id = p.product_id
""")
def q_stock_position(m: Model):
    """Flagship: on hand, reserved (sales scope), free, open and shortage lines per product."""
    return stock.stock_overview(m.product, m.sales_order, m.sales_line)


def _mo_components(m: Model):
    return bom.instantiate_components(m.manufacturing_order, m.bom_component)


def _position_all(m: Model):
    # Orders have one row per id, and only open ones reserve: the others' components are not built.
    mos = m.manufacturing_order.filter(F.col("status").isin(*OPEN_MO))
    r = stock.reserved_all(m.sales_order, m.sales_line, mos, bom.instantiate_components(mos, m.bom_component))
    return stock.stock_position(m.product, r)


def _position_sales(m: Model):
    return stock.stock_position(m.product, stock.reserved_sales(m.sales_order, m.sales_line))


@query("reserved_sales", sql="""
select p.product_id, cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty
from product p left join reserved_sales r on r.product_id = p.product_id""")
def q_reserved_sales(m: Model):
    """Reserved per product over open sales lines; 0 when none."""
    return stock.reserved_sales(m.sales_order, m.sales_line, m.product)


@query("reserved_all", sql="""
select p.product_id, cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty
from product p left join reserved_all r on r.product_id = p.product_id""")
def q_reserved_all(m: Model):
    """Reserved per product over open sales lines and open MO components."""
    return stock.reserved_all(m.sales_order, m.sales_line, m.manufacturing_order,
                              _mo_components(m), m.product)


@query("apply_reserved", sql="""
select p.product_id, p.reference, cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty
from product p left join reserved_all r on r.product_id = p.product_id""")
def q_apply_reserved(m: Model):
    """Products start with reserved 0; the reserved_all rows update matched products."""
    base = m.product.select("product_id", "reference", F.lit(0).alias("reserved_qty"))
    r = stock.reserved_all(m.sales_order, m.sales_line, m.manufacturing_order, _mo_components(m))
    return stock.apply_reserved(base, r).select("product_id", "reference", "reserved_qty")


@query("stock_position_all", sql="select * from position_all")
def q_stock_position_all(m: Model):
    """D3 with reservations from sales lines and MO components."""
    return _position_all(m)


@query("line_availability", sql="""
select l.order_id, l.line_seq, l.product_id, l.ordered_qty,
       case when l.ordered_qty > p.on_hand_qty - p.reserved_qty then 'Shortage' else 'Available' end as availability
from sales_line l left join position_all p on p.product_id = l.product_id""")
def q_line_availability(m: Model):
    """G11 (mode sales) on every sales line, read time, reservations of D2."""
    lines = m.sales_line.select("order_id", "line_seq", "product_id", "ordered_qty")
    return stock.line_availability(lines, _position_all(m), mode="sales")


@query("mo_component_availability", sql="""
select c.mo_id, c.product_id, c.to_consume_qty,
       case when p.on_hand_qty - p.reserved_qty >= c.to_consume_qty then 'Available' else 'Not Available' end as availability
from mo_component c left join position_all p on p.product_id = c.product_id""")
def q_mo_component_availability(m: Model):
    """G11 (mode mo) on MO components."""
    comps = _mo_components(m).select("mo_id", "product_id", "to_consume_qty")
    return stock.line_availability(comps, _position_all(m), need="to_consume_qty", mode="mo")


@query("shortages", sql="""
select order_id, line_seq, product_id, cast(outstanding_qty as decimal(20,3)) as outstanding_qty,
       cast(least(outstanding_qty, greatest(cum - greatest(on_hand_qty, 0), 0)) as decimal(20,3)) as short_qty
from (select l.order_id, l.line_seq, l.product_id, p.on_hand_qty,
             greatest(l.ordered_qty - l.done_qty, 0) as outstanding_qty,
             sum(greatest(l.ordered_qty - l.done_qty, 0)) over (partition by l.product_id
                 order by o.creation_date, l.order_id, l.line_seq rows between unbounded preceding and current row) as cum
      from sales_line l join sales_order o on o.id = l.order_id
      left join product p on p.product_id = l.product_id
      where o.status in ('Confirmed', 'Partially Delivered')) x""")
def q_shortages(m: Model):
    """K1: shortage per open sales line by a running sum per product."""
    return stock.shortages(m.sales_order, m.sales_line, m.product)


# --------------------------------------------------------------------------
# Lines (B3, B10, C1, D19)
# --------------------------------------------------------------------------


@query("valid_lines", sql="""
select order_id, line_seq, product_id,
       cast(coalesce(nullif(ordered_qty, 0), 1) as decimal(14,3)) as ordered_qty,
       cast(coalesce(done_qty, 0) as decimal(14,3)) as done_qty
from sales_line where product_id is not null and product_id <> 0""")
def q_valid_lines(m: Model):
    """Lines with a product; ordered 0/null -> 1, done null -> 0."""
    return lines.valid_lines(m.sales_line.select("order_id", "line_seq", "product_id",
                                                 "ordered_qty", "done_qty"))


@query("enrich_sales_lines", sql="""
select l.order_id, l.line_seq, l.product_id, l.ordered_qty, p.product_name, 'Units' as unit,
       p.sales_price as unit_price, cast(p.sales_price * l.ordered_qty as decimal(20,2)) as total,
       case when s.on_hand_qty - s.reserved_qty >= l.ordered_qty then 'Available' else 'Shortage' end as availability
from sales_line l join product p on p.product_id = l.product_id
left join position_sales s on s.product_id = l.product_id""")
def q_enrich_sales_lines(m: Model):
    """C1 + B3: product name, unit, price from the product, booked total, snapshot availability."""
    src = m.sales_line.select("order_id", "line_seq", "product_id", "ordered_qty")
    found, _ = lines.enrich_lines(src, m.product, "sales", _position_sales(m))
    return found


@query("line_lookup_rejects", sql="""
select l.order_id, l.line_seq, l.product_id, 'Product not found' as error
from sales_line l where not exists (select 1 from product p where p.product_id = l.product_id and p.procure_on_demand)""")
def q_line_lookup_rejects(m: Model):
    """Sales lines whose product is not among those procured on demand."""
    src = m.sales_line.select("order_id", "line_seq", "product_id")
    _, rejects = lines.lookup(src, m.product.filter("procure_on_demand"), "product_id", "product_id", "Product")
    return rejects


@query("order_totals_view", sql="""
select l.order_id, count(*) as line_count,
       cast(sum(cast(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.sales_price as decimal(20,2))) as decimal(20,2)) as order_total
from sales_line l join product p on p.product_id = l.product_id group by l.order_id""")
def q_order_totals_view(m: Model):
    """D19 (view rule): delivered qty if > 0 else ordered, times the price, per order."""
    src = m.sales_line.join(m.product.select("product_id", "sales_price"), "product_id")
    return lines.order_totals(src, "sales_price", "view")


@query("order_totals_booked", sql="""
select l.order_id, count(*) as line_count,
       cast(sum(cast(l.ordered_qty * p.cost_price as decimal(20,2))) as decimal(20,2)) as order_total
from purchase_line l join product p on p.product_id = l.product_id group by l.order_id""")
def q_order_totals_booked(m: Model):
    """D19 (booked rule) on purchase lines: ordered x cost price, per order."""
    src = m.purchase_line.join(m.product.select("product_id", "cost_price"), "product_id")
    return lines.order_totals(src, "cost_price", "booked")


# --------------------------------------------------------------------------
# BoM (C4-C7) and summaries
# --------------------------------------------------------------------------


@query("instantiate_components", sql="select * from mo_component")
def q_instantiate_components(m: Model):
    """MO components = BoM components x MO quantity."""
    return _mo_components(m)


@query("instantiate_operations", sql="""
select mo.id as mo_id, bo.operation_name, bo.work_center,
       cast(bo.expected_duration * coalesce(nullif(mo.quantity, 0), 1) as decimal(20,2)) as expected_duration,
       cast(0 as decimal(20,2)) as real_duration, 'Draft' as status
from manufacturing_order mo join bom_operation bo on bo.bom_id = mo.bom_id""")
def q_instantiate_operations(m: Model):
    """C7 + K3: work orders from BoM operations, durations scaled by MO quantity."""
    return bom.instantiate_operations(m.manufacturing_order, m.bom_operation, scale_duration=True)


@query("bom_component_names", sql="""
select c.bom_id, c.component_product_id, p.product_name as component_name,
       cast(coalesce(nullif(c.to_consume_qty, 0), 1) as decimal(14,3)) as to_consume_qty, 'Units' as unit
from bom_component c left join product p on p.product_id = c.component_product_id""")
def q_bom_component_names(m: Model):
    """Component names, default quantity 1 and unit."""
    return bom.bom_component_names(m.bom_component, m.product)


@query("bom_summary_components", sql="""
select b.*, p.product_name as finished_product_name, c.component_product_id,
       cp.product_name as component_name, c.to_consume_qty
from bom b join product p on p.product_id = b.finished_product_id
left join bom_component c on c.bom_id = b.id
left join product cp on cp.product_id = c.component_product_id""")
def q_bom_summary_components(m: Model):
    """D7 flat: BoM header + finished product name + one row per component."""
    comps, _ = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product)
    return comps


@query("bom_summary_operations", sql="""
select b.*, p.product_name as finished_product_name, o.operation_name, o.work_center, o.expected_duration
from bom b join product p on p.product_id = b.finished_product_id
left join bom_operation o on o.bom_id = b.id""")
def q_bom_summary_operations(m: Model):
    """D7 flat: BoM header + one row per operation."""
    _, ops = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product)
    return ops


@query("bom_summary_nested", sql="""
select b.id, p.product_name as finished_product_name,
       (select count(*) from bom_component c where c.bom_id = b.id) as component_count,
       (select count(*) from bom_operation o where o.bom_id = b.id) as operation_count,
       cast((select coalesce(sum(c.to_consume_qty), 0) from bom_component c where c.bom_id = b.id) as decimal(20,3)) as component_qty,
       cast((select coalesce(sum(o.expected_duration), 0) from bom_operation o where o.bom_id = b.id) as decimal(20,2)) as total_duration
from bom b join product p on p.product_id = b.finished_product_id""")
def q_bom_summary_nested(m: Model):
    """D7 nested: arrays of components and operations without fan-out, checked by size and sums."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    return doc.select(
        "id", "finished_product_name",
        F.size("components").cast("bigint").alias("component_count"),
        F.size("operations").cast("bigint").alias("operation_count"),
        F.aggregate("components", F.lit(0).cast("decimal(20,3)"),
                    lambda acc, c: (acc + c["to_consume_qty"]).cast("decimal(20,3)")).cast("decimal(20,3)").alias("component_qty"),
        F.aggregate("operations", F.lit(0).cast("decimal(20,2)"),
                    lambda acc, o: (acc + o["expected_duration"]).cast("decimal(20,2)")).cast("decimal(20,2)").alias("total_duration"))


_SALES_SUMMARY_SQL = """
select o.*, u.name as sales_person_name, x.line_seq, x.product_id, x.product_name, x.availability,
       x.ordered_qty, x.delivered_qty, x.unit_price, x.total
from sales_order o left join app_user u on u.id = o.sales_person_id
left join (select l.order_id, l.line_seq, l.product_id, p.product_name,
                  case when l.ordered_qty > s.on_hand_qty - s.reserved_qty then 'Shortage' else 'Available' end as availability,
                  l.ordered_qty, l.done_qty as delivered_qty, p.sales_price as unit_price,
                  cast(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.sales_price as decimal(20,2)) as total
           from sales_line l left join product p on p.product_id = l.product_id
           left join position_all s on s.product_id = l.product_id) x on x.order_id = o.id"""


@query("sales_order_summary", sql=_SALES_SUMMARY_SQL)
def q_sales_order_summary(m: Model):
    """D8 flat: order + sales person + one row per line (availability, view-rule total)."""
    return summaries.sales_order_summary(m.sales_order, m.sales_line, m.product, m.app_user,
                                         _position_all(m))


@query("sales_order_summary_nested", sql="""
select o.id, o.status, count(l.order_id) as line_count,
       cast(coalesce(sum(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.sales_price), 0) as decimal(20,2)) as order_total
from sales_order o left join sales_line l on l.order_id = o.id
left join product p on p.product_id = l.product_id group by o.id, o.status""")
def q_sales_order_summary_nested(m: Model):
    """D8 nested: one row per order with its line array; checked by size and total."""
    doc = summaries.sales_order_summary(m.sales_order, m.sales_line, m.product, m.app_user,
                                        _position_all(m), flat=False)
    return doc.select("id", "status", F.size("lines").cast("bigint").alias("line_count"),
                      F.aggregate("lines", F.lit(0).cast("decimal(20,2)"),
                                  lambda acc, x: (acc + F.coalesce(x["total"], F.lit(0))).cast("decimal(20,2)"))
                      .cast("decimal(20,2)").alias("order_total"))


@query("sales_order_nested_lines", sql="""
select o.id, u.name as sales_person_name, l.line_seq, l.product_id, p.product_name,
       case when l.ordered_qty > s.on_hand_qty - s.reserved_qty then 'Shortage' else 'Available' end as availability,
       l.ordered_qty, l.done_qty as delivered_qty, p.sales_price as unit_price,
       cast(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.sales_price as decimal(20,2)) as total
from sales_order o left join app_user u on u.id = o.sales_person_id
join sales_line l on l.order_id = o.id left join product p on p.product_id = l.product_id
left join position_all s on s.product_id = l.product_id""")
def q_sales_order_nested_lines(m: Model):
    """D8 nested, contents: every line of every order's document."""
    doc = summaries.sales_order_summary(m.sales_order, m.sales_line, m.product, m.app_user, _position_all(m), flat=False)
    return lines.flatten(doc, "lines", keep=["id", "sales_person_name"])


@query("purchase_order_nested_lines", sql="""
select o.id, u.name as responsible_person_name, l.line_seq, l.product_id, p.product_name, l.ordered_qty,
       l.done_qty as received_qty, p.cost_price as unit_price,
       cast(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.cost_price as decimal(20,2)) as total
from purchase_order o left join app_user u on u.id = o.responsible_person_id
join purchase_line l on l.order_id = o.id left join product p on p.product_id = l.product_id""")
def q_purchase_order_nested_lines(m: Model):
    """D9 nested, contents: every line of every purchase order's document."""
    doc = summaries.purchase_order_summary(m.purchase_order, m.purchase_line, m.product, m.app_user, flat=False)
    return lines.flatten(doc, "lines", keep=["id", "responsible_person_name"])


def _mo_documents(m: Model):
    return summaries.manufacturing_order_summary(
        m.manufacturing_order, _mo_components(m), bom.instantiate_operations(m.manufacturing_order, m.bom_operation, True),
        m.product, m.app_user, _position_all(m), flat=False)


@query("mo_nested_components", sql="""
select mo.id, fp.product_name as finished_product_name, c.product_id, p.product_name,
       case when s.on_hand_qty - s.reserved_qty >= c.to_consume_qty then 'Available' else 'Not Available' end as availability,
       c.to_consume_qty, c.consumed_qty
from manufacturing_order mo join product fp on fp.product_id = mo.finished_product_id
join mo_component c on c.mo_id = mo.id left join product p on p.product_id = c.product_id
left join position_all s on s.product_id = c.product_id""")
def q_mo_nested_components(m: Model):
    """D10 nested, contents: every component of every manufacturing order's document."""
    return lines.flatten(_mo_documents(m), "components", keep=["id", "finished_product_name"])


@query("mo_nested_operations", sql="""
select mo.id, bo.operation_name, bo.work_center,
       cast(bo.expected_duration * coalesce(nullif(mo.quantity, 0), 1) as decimal(20,2)) as expected_duration,
       cast(0 as decimal(20,2)) as real_duration, 'Draft' as wo_status
from manufacturing_order mo join product fp on fp.product_id = mo.finished_product_id
join bom_operation bo on bo.bom_id = mo.bom_id""")
def q_mo_nested_operations(m: Model):
    """D10 nested, contents: every work order of every manufacturing order's document."""
    return lines.flatten(_mo_documents(m), "operations", keep=["id"])


@query("flatten_bom_operations", sql="""
select b.id, o.operation_name, o.work_center, o.expected_duration
from bom b join product p on p.product_id = b.finished_product_id join bom_operation o on o.bom_id = b.id""")
def q_flatten_bom_operations(m: Model):
    """F6 on D7: every operation of every BoM's document."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    return lines.flatten(doc, "operations", keep=["id"])


@query("collect_distinct_components", sql="""
select distinct bom_id, component_product_id, to_consume_qty from bom_component""")
def q_collect_distinct_components(m: Model):
    """The distinct components per BoM out of a components x operations fan-out."""
    fanned = m.bom_component.join(m.bom_operation.select("bom_id", "operation_name"), "bom_id")
    doc = summaries.collect_distinct(fanned, "bom_id", ["component_product_id", "to_consume_qty"], "components")
    return lines.flatten(doc, "components", keep=["bom_id"])


@query("sales_line_text", sql="""
select o.id, coalesce(string_agg(coalesce(p.product_name, '') || ' ' || cast(l.ordered_qty as varchar) || ' ' ||
       case when l.ordered_qty > s.on_hand_qty - s.reserved_qty then 'Shortage' else 'Available' end, '<br>'
       order by l.line_seq), '') as line_text
from sales_order o left join sales_line l on l.order_id = o.id left join product p on p.product_id = l.product_id
left join position_all s on s.product_id = l.product_id group by o.id""")
def q_sales_line_text(m: Model):
    """D16: 'name qty availability' per line, joined per order."""
    doc = summaries.sales_order_summary(m.sales_order, m.sales_line, m.product, m.app_user, _position_all(m), flat=False)
    return doc.select("id", search.line_text("lines").alias("line_text"))


@query("purchase_order_summary", sql="""
select o.*, u.name as responsible_person_name, x.line_seq, x.product_id, x.product_name,
       x.ordered_qty, x.received_qty, x.unit_price, x.total
from purchase_order o left join app_user u on u.id = o.responsible_person_id
left join (select l.order_id, l.line_seq, l.product_id, p.product_name, l.ordered_qty,
                  l.done_qty as received_qty, p.cost_price as unit_price,
                  cast(case when l.done_qty > 0 then l.done_qty else l.ordered_qty end * p.cost_price as decimal(20,2)) as total
           from purchase_line l left join product p on p.product_id = l.product_id) x on x.order_id = o.id""")
def q_purchase_order_summary(m: Model):
    """D9 flat: purchase order + responsible person + one row per line."""
    return summaries.purchase_order_summary(m.purchase_order, m.purchase_line, m.product, m.app_user)


@query("mo_summary_components", sql="""
select mo.*, fp.product_name as finished_product_name, u.name as assignee_name,
       x.product_id, x.product_name, x.availability, x.to_consume_qty, x.consumed_qty
from manufacturing_order mo join product fp on fp.product_id = mo.finished_product_id
left join app_user u on u.id = mo.assignee_id
left join (select c.mo_id, c.product_id, p.product_name,
                  case when s.on_hand_qty - s.reserved_qty >= c.to_consume_qty then 'Available' else 'Not Available' end as availability,
                  c.to_consume_qty, c.consumed_qty
           from mo_component c left join product p on p.product_id = c.product_id
           left join position_all s on s.product_id = c.product_id) x on x.mo_id = mo.id""")
def q_mo_summary_components(m: Model):
    """D10 flat: MO + finished product + assignee + one row per component with availability."""
    comps, _ = summaries.manufacturing_order_summary(
        m.manufacturing_order, _mo_components(m),
        bom.instantiate_operations(m.manufacturing_order, m.bom_operation, True),
        m.product, m.app_user, _position_all(m))
    return comps


@query("mo_summary_operations", sql="""
select mo.*, fp.product_name as finished_product_name, u.name as assignee_name,
       w.operation_name, w.work_center, w.expected_duration, w.real_duration, w.status as wo_status
from manufacturing_order mo join product fp on fp.product_id = mo.finished_product_id
left join app_user u on u.id = mo.assignee_id
left join (select mo2.id as mo_id, bo.operation_name, bo.work_center,
                  cast(bo.expected_duration * coalesce(nullif(mo2.quantity, 0), 1) as decimal(20,2)) as expected_duration,
                  cast(0 as decimal(20,2)) as real_duration, 'Draft' as status
           from manufacturing_order mo2 join bom_operation bo on bo.bom_id = mo2.bom_id) w on w.mo_id = mo.id""")
def q_mo_summary_operations(m: Model):
    """D10 flat: MO header + one row per work order."""
    _, ops = summaries.manufacturing_order_summary(
        m.manufacturing_order, _mo_components(m),
        bom.instantiate_operations(m.manufacturing_order, m.bom_operation, True),
        m.product, m.app_user, _position_all(m))
    return ops


# --------------------------------------------------------------------------
# Dashboards, audit, search, kanban
# --------------------------------------------------------------------------

BOARD_USER = 7

_BOARD_SQL = """
select st.kind, st.pos, st.status, coalesce(a.all_count, 0) as all_count,
       coalesce(a.my_count, 0) as my_count, coalesce(a.late_count, 0) as late_count
from (values ('sales', 0, 'Draft'), ('sales', 1, 'Confirmed'), ('sales', 2, 'Partially Delivered'),
             ('sales', 3, 'Fully Delivered'), ('purchase', 0, 'Draft'), ('purchase', 1, 'Confirmed'),
             ('purchase', 2, 'Partially Received'), ('purchase', 3, 'Fully Received'),
             ('manufacturing', 0, 'Draft'), ('manufacturing', 1, 'Confirmed'),
             ('manufacturing', 2, 'In Progress'), ('manufacturing', 3, 'Done')) as st(kind, pos, status)
left join (
  select 'sales' as kind, status, count(*) as all_count,
         count(*) filter (where sales_person_id = 7) as my_count,
         count(*) filter (where due_date is not null and due_date < date '1998-07-01'
                          and status not in ('Fully Delivered', 'Fully Received', 'Done', 'Cancelled')) as late_count
  from sales_order group by status
  union all
  select 'purchase', status, count(*), count(*) filter (where responsible_person_id = 7),
         count(*) filter (where due_date is not null and due_date < date '1998-07-01'
                          and status not in ('Fully Delivered', 'Fully Received', 'Done', 'Cancelled'))
  from purchase_order group by status
  union all
  select 'manufacturing', status, count(*), count(*) filter (where assignee_id = 7), 0
  from manufacturing_order group by status) a
on a.kind = st.kind and a.status = st.status"""


@query("status_board", sql=_BOARD_SQL)
def q_status_board(m: Model):
    """All / mine / late per listed status for sales, purchase and manufacturing orders."""
    return boards.dashboard(m.sales_order, m.purchase_order, m.manufacturing_order, BOARD_USER, AS_OF)


@query("board_totals", sql="""
select kind, cast(sum(all_count) as bigint) as total from (""" + _BOARD_SQL + """) b group by kind
union all select 'logs', count(*) from audit_log""")
def q_board_totals(m: Model):
    """Orders per kind on the board (Cancelled excluded) and the audit log total."""
    board = boards.dashboard(m.sales_order, m.purchase_order, m.manufacturing_order, BOARD_USER, AS_OF)
    return boards.board_totals(board, m.audit_log)


@query("audit_counts", sql="""
select count(*) as total, count(*) filter (where action = 'Created') as created,
       count(*) filter (where action = 'Updated') as updated, count(*) filter (where action = 'Deleted') as deleted
from audit_log where (module = 'Sales' or record_type = 'Sales') and contains(record_id, '0001')""")
def q_audit_counts(m: Model):
    """B4 + D6: counts of the audit rows of module 'Sales' whose record id contains '0001'."""
    return audit.audit_counts(audit.filter_audit(m.audit_log, "Sales", "0001"))


@query("audit_counts_all", sql="""
select count(*) as total, count(*) filter (where action = 'Created') as created,
       count(*) filter (where action = 'Updated') as updated, count(*) filter (where action = 'Deleted') as deleted
from audit_log""")
def q_audit_counts_all(m: Model):
    """D6 without filters."""
    return audit.audit_counts(audit.filter_audit(m.audit_log, None, ""))


@query("filter_audit", sql="""
select id, module, record_type, record_id, action from audit_log
where (module = 'Product' or record_type = 'Product') and contains(record_id, '00002')""")
def q_filter_audit(m: Model):
    """Module or record type 'Product', record id containing '00002'."""
    return (audit.filter_audit(m.audit_log, "Product", "00002")
            .select("id", "module", "record_type", "record_id", "action"))


@query("newest_first", sql="select id, date_time, module, action from audit_log order by id desc")
def q_newest_first(m: Model):
    """Audit list, newest first."""
    return audit.newest_first(m.audit_log.select("id", "date_time", "module", "action"))


@query("kanban_columns", sql="""
select status, count(*) as card_count from sales_order_view
where status is not null and status <> '' group by status""")
def q_kanban_columns(m: Model):
    """Kanban columns of the sales list."""
    cols, _ = boards.kanban(sales_order_view(m))
    return cols


@query("kanban_cards", sql="""
select status, coalesce(nullif(reference, ''), 'Unknown') as title, coalesce(nullif(customer_name, ''), '') as subtitle
from sales_order_view where status is not null and status <> ''""")
def q_kanban_cards(m: Model):
    """Kanban cards (title, subtitle) of the sales list."""
    _, cards = boards.kanban(sales_order_view(m))
    return cards


@query("search_sales", sql="""
select id, reference, customer_name, status from sales_order_view
where (coalesce(contains(lower(reference), '#000001'), false) or coalesce(contains(lower(customer_name), '#000001'), false))
  and status = 'Confirmed'""")
def q_search_sales(m: Model):
    """Sales list search for '#000001' (reference or customer, any case) with status Confirmed."""
    return (search.search(sales_order_view(m), "sales", "#000001", "Confirmed")
            .select("id", "reference", "customer_name", "status"))


@query("search_products", sql="""
select product_id, reference, product_name from product
where coalesce(contains(lower(reference), 'blue'), false) or coalesce(contains(lower(product_name), 'blue'), false)""")
def q_search_products(m: Model):
    """Product search for 'BLUE' (case-insensitive) over reference and name."""
    return search.search(m.product, "products", "BLUE").select("product_id", "reference", "product_name")


@query("shown_of_total", sql="""
select count(*) filter (where contains(lower(customer_name), '#000001')) as shown, count(*) as total
from sales_order_view""")
def q_shown_of_total(m: Model):
    """D17: 'n of m' for a customer search on the sales list."""
    return boards.shown_of_total(sales_order_view(m), contains_ci("customer_name", "#000001"))


@query("distinct_statuses", sql="select distinct status from sales_order where status is not null and status <> ''")
def q_distinct_statuses(m: Model):
    """statuses present in the sales list."""
    return boards.distinct_values(m.sales_order, "status")


_ACTIONS_SQL = """
select '{kind}' as kind, id, concat_ws(',', 'Edit', 'Logs',
  case when status = 'Draft' then 'Confirm' end,
  case when {sales} and status in ('Confirmed', 'Partially Delivered') then 'Deliver' end,
  case when {purchase} and status in ('Confirmed', 'Partially Received') then 'Receive' end,
  case when {mfg} and status = 'Confirmed' then 'Start' end,
  case when {mfg} and status in ('Confirmed', 'In Progress') then 'Produce' end,
  case when status not in ('Fully Delivered', 'Fully Received', 'Done', 'Cancelled') then 'Cancel' end) as actions
from {table}"""


@query("allowed_actions", sql=" union all ".join(
    _ACTIONS_SQL.format(kind=k, table=t, sales=str(k == "sales").lower(),
                        purchase=str(k == "purchase").lower(), mfg=str(k == "manufacturing").lower())
    for k, t in (("sales", "sales_order"), ("purchase", "purchase_order"),
                 ("manufacturing", "manufacturing_order"))))
def q_allowed_actions(m: Model):
    """The actions offered per order from its status, for all three order kinds."""
    out = None
    for kind, df in (("sales", m.sales_order), ("purchase", m.purchase_order),
                     ("manufacturing", m.manufacturing_order)):
        part = (search.allowed_actions(df.select("id", "status"), kind)
                .select(F.lit(kind).alias("kind"), "id", F.array_join("actions", ",").alias("actions")))
        out = part if out is None else out.unionByName(part)
    return out


@query("procurement_label", sql="""
select product_id, case when procure_on_demand then coalesce(procurement_type, '') else 'MTS' end as procurement_label
from product""")
def q_procurement_label(m: Model):
    """Procurement label per product."""
    return search.procurement_label(m.product).select("product_id", "procurement_label")


# --------------------------------------------------------------------------
# Ledger and fulfilment
# --------------------------------------------------------------------------


@query("ledger", sql="""
select m.product_id, m.movement_date, m.order_id, m.line_seq, m.reference_type, m.movement_qty,
       cast(p.on_hand_qty + sum(m.movement_qty) over (partition by m.product_id
            order by m.movement_date, m.order_id, m.line_seq rows between unbounded preceding and current row)
            as decimal(20,3)) as resulting_on_hand
from stock_movement m left join product p on p.product_id = m.product_id""")
def q_ledger(m: Model):
    """Running on-hand balance per product from the opening balance."""
    return ledger.ledger(m.stock_movement, m.product.select("product_id", "on_hand_qty"),
                         ["movement_date", "order_id", "line_seq"])


@query("final_on_hand", sql="""
select p.product_id, cast(p.on_hand_qty + coalesce(s.net, 0) as decimal(20,3)) as on_hand_qty
from product p left join (select product_id, sum(movement_qty) as net from stock_movement group by product_id) s
on s.product_id = p.product_id""")
def q_final_on_hand(m: Model):
    """On hand after all movements per product (batch twin of the streaming job)."""
    return ledger.final_on_hand(m.stock_movement, m.product.select("product_id", "on_hand_qty"))


@query("ledger_balance_check", sql="""
select p.product_id, cast(p.on_hand_qty as decimal(20,3)) as on_hand_qty,
       cast(coalesce(s.net, 0) as decimal(20,3)) as ledger_qty
from product p left join (select product_id, sum(movement_qty) as net from stock_movement group by product_id) s
on s.product_id = p.product_id where p.on_hand_qty <> coalesce(s.net, 0)""")
def q_ledger_balance_check(m: Model):
    """H8: products whose on hand differs from the ledger (zero opening + movements)."""
    zero = m.product.select("product_id", F.lit(0).cast("decimal(14,3)").alias("on_hand_qty"))
    return ledger.check_ledger_balance(m.product, zero, m.stock_movement)


def _running_max_sql(table: str, req: str, need: str, sign: str) -> str:
    return f"""
select line_id, seq, cast(after_qty as decimal(20,3)) as done_after,
       cast({sign}(after_qty - before_qty) as decimal(20,3)) as movement_qty
from (select line_id, seq, greatest(0, coalesce(prior, 0)) as before_qty,
             greatest(greatest(0, coalesce(prior, 0)), capped) as after_qty
      from (select line_id, seq, capped,
                   max(capped) over (partition by line_id order by seq rows between unbounded preceding and 1 preceding) as prior
            from (select line_id, seq, least({req}, {need}) as capped from {table}) c) p) d
where after_qty > before_qty"""


@query("apply_deliveries", sql=_running_max_sql("fulfil_command", "coalesce(requested_qty, 0)", "ordered_qty", "-"))
def q_apply_deliveries(m: Model):
    """Delivery commands as a prefix max per line; emits the negative movements."""
    cmd = m.fulfil_command.withColumn("done_qty", F.lit(None).cast("decimal(14,3)"))
    return fulfil.apply_deliveries(cmd, ["line_id"], ["seq"])


@query("apply_receipts", sql=_running_max_sql("receipt_command", "coalesce(requested_qty, 0)", "ordered_qty", ""))
def q_apply_receipts(m: Model):
    """Receipt commands; emits the positive movements."""
    cmd = receipt_command(m).withColumn("done_qty", F.lit(None).cast("decimal(14,3)"))
    return fulfil.apply_receipts(cmd, ["line_id"], ["seq"])


@query("apply_consumption", sql=_running_max_sql(
    "consume_command", "case when requested_qty is null or requested_qty = 0 then need_qty else requested_qty end",
    "need_qty", "-"))
def q_apply_consumption(m: Model):
    """Consumption commands; 0 means the full need."""
    cmd = consume_command(m).withColumn("done_qty", F.lit(None).cast("decimal(14,3)"))
    return fulfil.apply_consumption(cmd, ["line_id"], ["seq"], need_col="need_qty")


@query("finished_movements", sql="""
select r.mo_id, r.seq, mo.finished_product_id as product_id, cast(mo.quantity as decimal(20,3)) as movement_qty
from produce_request r join manufacturing_order mo on mo.id = r.mo_id""")
def q_finished_movements(m: Model):
    """E5: +quantity of the finished product for every produce request, repeated ones included."""
    _, requests = produce_requests(m, _mo_components(m))
    return fulfil.finished_movements(requests, m.manufacturing_order)


@query("completion_status", sql="""
select o.id as order_id,
       case when coalesce(bool_and(coalesce(l.done_qty, 0) >= l.ordered_qty), true) then 'Fully Received'
            else 'Partially Received' end as status
from purchase_order o left join purchase_line l on l.order_id = o.id group by o.id""")
def q_completion_status(m: Model):
    """Fully / Partially Received per purchase order from its lines."""
    return fulfil.completion_status(m.purchase_order, m.purchase_line, "purchase")


def _fulfil_sql(kind: str) -> str:
    """CTEs: every command's line before and after it (steps), every request
    (asked), and the lines each request completes (per_req)."""
    commands, line_table, empties, order_table = {
        "sales": ("deliver_command", "sales_line", "sales_empty_request", "sales_order"),
        "purchase": ("receive_command", "purchase_line", "purchase_empty_request", "purchase_order")}[kind]
    return f"""
with applied as (
  select c.order_id, c.line_seq, l.product_id, c.cmd_time, l.ordered_qty, coalesce(l.done_qty, 0) as init_qty,
         least(coalesce(c.requested_qty, 0), l.ordered_qty) as capped,
         max(least(coalesce(c.requested_qty, 0), l.ordered_qty)) over (partition by c.order_id, c.line_seq
             order by c.cmd_time rows between unbounded preceding and 1 preceding) as prior
  from {commands} c join {line_table} l on l.order_id = c.order_id and l.line_seq = c.line_seq),
steps as (
  select *, greatest(init_qty, coalesce(prior, init_qty)) as before_qty,
         greatest(greatest(init_qty, coalesce(prior, init_qty)), capped) as after_qty from applied),
asked as (
  select order_id, cmd_time from {commands} union select order_id, cmd_time from {empties}),
per_req as (
  select a.order_id, a.cmd_time, count(s.line_seq) filter (where before_qty < ordered_qty and after_qty >= ordered_qty) as done_lines
  from asked a left join steps s on s.order_id = a.order_id and s.cmd_time = a.cmd_time
  where a.order_id in (select id from {order_table}) group by a.order_id, a.cmd_time),
incomplete as (
  select order_id, count(*) filter (where coalesce(done_qty, 0) < ordered_qty) as n from {line_table} group by order_id),
lines_after as (
  select l.order_id, l.line_seq, l.product_id, l.ordered_qty, cast(coalesce(s.after_qty, l.done_qty) as decimal(20,3)) as done_qty
  from {line_table} l left join (select order_id, line_seq, max(after_qty) as after_qty from steps group by order_id, line_seq) s
    on s.order_id = l.order_id and s.line_seq = l.line_seq)
"""


def _movement_sql(kind: str) -> str:
    sign = "-" if kind == "sales" else ""
    return _fulfil_sql(kind) + f"""
select order_id, line_seq, product_id, cmd_time, cast({sign}(after_qty - before_qty) as decimal(20,3)) as movement_qty
from steps where after_qty > before_qty"""


def _status_sql(kind: str, word: str) -> str:
    return _fulfil_sql(kind) + f"""
select a.order_id, case when coalesce(bool_and(coalesce(l.done_qty, 0) >= l.ordered_qty), true)
                        then 'Fully {word}' else 'Partially {word}' end as status
from (select distinct order_id from per_req) a left join lines_after l on l.order_id = a.order_id
group by a.order_id"""


def _audit_sql(kind: str, word: str, module: str) -> str:
    return _fulfil_sql(kind) + f"""
select r.order_id, r.cmd_time, '{module}' as module, '{module}Order' as record_type, 'Updated' as action,
       'status' as field_changed, '' as old_value,
       case when coalesce(i.n, 0) - sum(r.done_lines) over (partition by r.order_id order by r.cmd_time
                 rows between unbounded preceding and current row) <= 0
            then 'Fully {word}' else 'Partially {word}' end as new_value
from per_req r left join incomplete i on i.order_id = r.order_id"""


def _ledger_sql(kind: str) -> str:
    sign = "-" if kind == "sales" else ""
    return _fulfil_sql(kind) + f"""
select s.order_id, s.line_seq, s.product_id, s.cmd_time, cast({sign}(s.after_qty - s.before_qty) as decimal(20,3)) as movement_qty,
       cast(p.on_hand_qty + sum({sign}(s.after_qty - s.before_qty)) over (partition by s.product_id
            order by s.cmd_time, s.order_id, s.line_seq rows between unbounded preceding and current row) as decimal(20,3))
         as resulting_on_hand
from steps s left join product p on p.product_id = s.product_id where s.after_qty > s.before_qty"""


def _deliveries(m: Model):
    return fulfil.fulfil_sales(m.sales_order, m.sales_line, deliver_command(m), ["cmd_time"],
                               m.product.select("product_id", "on_hand_qty"), empty_requests(m.sales_order))


def _receipts(m: Model):
    return fulfil.fulfil_purchases(m.purchase_order, m.purchase_line, receive_command(m), ["cmd_time"],
                                   m.product.select("product_id", "on_hand_qty"), empty_requests(m.purchase_order))


@query("fulfil_movements", sql=_movement_sql("sales"))
def q_fulfil_movements(m: Model):
    """Stock movements from delivering all open sales lines."""
    return _deliveries(m)["movements"]


@query("fulfil_order_status", sql=_status_sql("sales", "Delivered"))
def q_fulfil_order_status(m: Model):
    """E6 + D13: status of every order that received a delivery request (one without lines, too)."""
    return _deliveries(m)["status"]


@query("fulfil_audit_rows", sql=_audit_sql("sales", "Delivered", "Sales"))
def q_fulfil_audit_rows(m: Model):
    """E6 + E10: one audit row per deliver request with the order's status right after it."""
    return _deliveries(m)["audit"]


@query("fulfil_ledger", sql=_ledger_sql("sales"))
def q_fulfil_ledger(m: Model):
    """E6 + E1: the delivery movements with the running on-hand from the products' stock."""
    return _deliveries(m)["ledger"]


@query("receive_movements", sql=_movement_sql("purchase"))
def q_receive_movements(m: Model):
    """Stock movements from receiving all open purchase lines."""
    return _receipts(m)["movements"]


@query("receive_lines_after", sql=_fulfil_sql("purchase") + " select * from lines_after")
def q_receive_lines_after(m: Model):
    """Every purchase line with its received quantity after the receive requests."""
    return _receipts(m)["lines"]


@query("receive_order_status", sql=_status_sql("purchase", "Received"))
def q_receive_order_status(m: Model):
    """E6 + D13: Fully / Partially Received per purchase order that received a request."""
    return _receipts(m)["status"]


@query("receive_audit_rows", sql=_audit_sql("purchase", "Received", "Purchase"))
def q_receive_audit_rows(m: Model):
    """E6 + E10: one audit row per receive request with the order's status right after it."""
    return _receipts(m)["audit"]


@query("receive_ledger", sql=_ledger_sql("purchase"))
def q_receive_ledger(m: Model):
    """E6 + E1: the receipts with the running on-hand from the products' stock."""
    return _receipts(m)["ledger"]


# --------------------------------------------------------------------------
# Change feeds, status sequences, numbering
# --------------------------------------------------------------------------


_COMPACT_SQL = """
select g.record_id, case when g.vseq >= g.last_create then f.new_value end as new_value,
       fl.new_label, g.last_seq
from (select record_id, max(case when op = 'create' then seq end) as last_create,
             max(case when op = 'delete' then seq end) as last_delete,
             max(case when op in ('create', 'update') then seq end) as last_seq,
             max(case when new_value is not null then seq end) as vseq
      from change_feed group by record_id) g
left join change_feed f on f.record_id = g.record_id and f.seq = g.vseq
left join change_feed fl on fl.record_id = g.record_id and fl.seq = g.last_seq
where g.last_create is not null and (g.last_delete is null or g.last_create > g.last_delete)"""


@query("compact_changes", sql=_COMPACT_SQL)
def q_compact_changes(m: Model):
    """Live records after the create / update / delete feed (value: latest sent, label: overlay)."""
    return changes.compact_changes(m.change_feed, "record_id", keep_cols=["new_value"],
                                   overlay_cols=["new_label"])


@query("feed_rejects", sql="""
select record_id, seq, op, 'not found' as error from (
  select *, max(case when op = 'create' then seq end) over w as pc, max(case when op = 'delete' then seq end) over w as pd
  from change_feed window w as (partition by record_id order by seq rows between unbounded preceding and 1 preceding)) x
where op in ('update', 'delete') and not (pc is not null and (pd is null or pc > pd))""")
def q_feed_rejects(m: Model):
    """Updates and deletes of records that do not exist at that point."""
    return changes.feed_rejects(m.change_feed, "record_id")


_PATCH_BASE = "select product_id, reference, product_name, on_hand_qty, procurement_type from product"


@query("overlay_patch", sql="""
select p.product_id, p.reference,
       case when n.seq is not null then n.name else p.product_name end as product_name,
       case when q.seq is not null then case when q.event_type = 'click' then cast(cast(q.value as varchar) as decimal(14,3)) else cast(0 as decimal(14,3)) end else p.on_hand_qty end as on_hand_qty,
       case when t.seq is not null then null else p.procurement_type end as procurement_type
from product p
left join (select user_id, max(event_id) as seq, max_by(concat('renamed ', cast(event_id as varchar)), event_id) as name
           from events where event_type = 'signup' group by user_id) n on n.user_id = p.product_id
left join (select user_id, max(event_id) as seq, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value
           from events where event_type in ('click', 'purchase') group by user_id) q on q.user_id = p.product_id
left join (select user_id, max(event_id) as seq from events where event_type = 'error' group by user_id) t
  on t.user_id = p.product_id""")
def q_overlay_patch(m: Model):
    """Product edits applied in order; present fields overwrite (null too); reference protected."""
    base = m.product.select("product_id", "reference", "product_name", "on_hand_qty", "procurement_type")
    return changes.overlay_patch(base, product_patch(m), "product_id")


@query("keep_patch", sql="""
select p.product_id, p.reference, coalesce(n.name, p.product_name) as product_name,
       coalesce(cast(cast(q.value as varchar) as decimal(14,3)), p.on_hand_qty) as on_hand_qty, p.procurement_type
from product p
left join (select user_id, max_by(concat('renamed ', cast(event_id as varchar)), event_id) as name
           from events where event_type = 'signup' group by user_id) n on n.user_id = p.product_id
left join (select user_id, max_by(value, event_id) as value from events
           where event_type = 'click' and value <> 0 group by user_id) q on q.user_id = p.product_id""")
def q_keep_patch(m: Model):
    """Product edits where only non-empty, non-zero values replace the old ones."""
    base = m.product.select("product_id", "reference", "product_name", "on_hand_qty", "procurement_type")
    return changes.keep_patch(base, product_patch(m), "product_id")


_CREATED_ALLOWED_SQL = """(select distinct a.user_id from audit_log a where a.action = 'Created'
   and a.user_id in (select id from app_user))"""


@query("replace_children", sql="""
select p.user_id, p.module, p.can_view from permission p
where p.user_id not in """ + _CREATED_ALLOWED_SQL + """
union all
select u.user_id, m.module,
       case when exists (select 1 from audit_log a where a.user_id = u.user_id and a.action = 'Created' and a.module = m.module)
            then 'Full' else 'None' end as can_view
from """ + _CREATED_ALLOWED_SQL + """ u
cross join (values ('Sales'), ('Purchase'), ('Manufacturing'), ('Product'), ('BoM'), ('Audit'), ('User')) as m(module)""")
def q_replace_children(m: Model):
    """E7c / F5 (+ C9, C13): users who created records get a new permission set for the modules they created in."""
    return changes.replace_children(m.permission, _matrix_from_audit(m).select("user_id", "module", "can_view"),
                                    "user_id")


def _matrix_from_audit(m: Model):
    created = access.exists_in(m.audit_log.filter(F.col("action") == "Created"),
                               m.app_user.withColumnRenamed("id", "user_id"), ["user_id"])
    allowed = created.groupBy("user_id").agg(F.collect_set("module").alias("modules"))
    return access.permission_matrix(allowed)


_MO_STATUS = "select id, status from manufacturing_order"


@query("final_status", sql="""
select mo.id as order_id, coalesce(c.status, mo.status, 'Draft') as status
from manufacturing_order mo left join (
  select order_id, max_by(case command when 'confirm' then 'Confirmed' when 'start' then 'In Progress'
                                       when 'produce' then 'Done' when 'cancel' then 'Cancelled' end, seq) as status
  from status_command group by order_id) c on c.order_id = mo.id""")
def q_final_status(m: Model):
    """Status of every manufacturing order after the status commands (last wins)."""
    return changes.final_status(m.manufacturing_order.select("id", "status"), status_command(m))


_PREV_SQL = """
select c.order_id, c.seq, c.command, c.new_status,
       coalesce(lag(c.new_status) over (partition by c.order_id order by c.seq), mo.status, 'Draft') as old_status
from (select order_id, seq, command,
             case command when 'confirm' then 'Confirmed' when 'start' then 'In Progress'
                          when 'produce' then 'Done' when 'cancel' then 'Cancelled' end as new_status
      from status_command) c
left join manufacturing_order mo on mo.id = c.order_id"""


@query("audit_rows", sql="""
select seq, 'Manufacturing' as module, 'ManufacturingOrder' as record_type, order_id as record_id,
       'System' as user_name, 'Updated' as action, 'status' as field_changed,
       old_status as old_value, new_status as new_value
from (""" + _PREV_SQL + ") x")
def q_audit_rows(m: Model):
    """E10 (style real): audit row per status command with the previous status as old value."""
    return changes.audit_rows(m.manufacturing_order.select("id", "status"), status_command(m),
                              "Manufacturing", "ManufacturingOrder", style="real")


@query("audit_rows_reference_style", sql="""
select event_id as seq, 'Manufacturing' as module, 'ManufacturingOrder' as record_type, user_id as record_id,
       'System' as user_name, 'Updated' as action, 'status' as field_changed,
       case when event_type in ('view', 'signup') then 'Draft' else '' end as old_value,
       case when event_type in ('view', 'signup') then 'Confirmed' when event_type = 'click' then 'In Progress'
            when event_type = 'purchase' then 'Done' else 'Cancelled' end as new_value
from events""")
def q_audit_rows_reference_style(m: Model):
    """E10 (style reference): old value 'Draft' on confirm, '' otherwise."""
    return changes.audit_rows(m.manufacturing_order.select("id", "status"), status_command(m),
                              "Manufacturing", "ManufacturingOrder", style="reference")


@query("illegal_transitions", sql="""
select order_id, seq, command, old_status, new_status from (""" + _PREV_SQL + """) x
where not exists (select 1 from (values ('Draft', 'confirm'), ('Draft', 'cancel'), ('Confirmed', 'start'),
                                        ('Confirmed', 'produce'), ('Confirmed', 'cancel'), ('In Progress', 'produce'),
                                        ('In Progress', 'cancel')) as a(s, c)
                  where a.s = x.old_status and a.c = x.command)""")
def q_illegal_transitions(m: Model):
    """Status commands the client would not have offered at that point."""
    return changes.illegal_transitions(m.manufacturing_order.select("id", "status"), status_command(m))


def _sequence_sql(kind: str, word: str) -> str:
    """Status commands on sales / purchase orders with the status before each."""
    table = f"{kind}_order"
    verb = "deliver" if kind == "sales" else "receive"
    return f"""
select c.order_id, c.seq, c.command, c.new_status,
       coalesce(lag(c.new_status) over (partition by c.order_id order by c.seq), o.status, 'Draft') as old_status
from (select user_id as order_id, event_id as seq,
             case when event_type in ('view', 'signup') then 'confirm' when event_type = 'error' then 'cancel' else '{verb}' end as command,
             case when event_type in ('view', 'signup') then 'Confirmed' when event_type = 'error' then 'Cancelled'
                  when value >= 50 then 'Fully {word}' else 'Partially {word}' end as new_status
      from events) c
left join {table} o on o.id = c.order_id"""


def _illegal_sql(kind: str, word: str) -> str:
    verb = "deliver" if kind == "sales" else "receive"
    return f"""
select order_id, seq, command, old_status, new_status from ({_sequence_sql(kind, word)}) x
where not coalesce((command = 'confirm' and old_status = 'Draft')
                or (command = '{verb}' and old_status in ('Confirmed', 'Partially {word}'))
                or (command = 'cancel' and old_status in ('Draft', 'Confirmed', 'Partially {word}')), false)"""


def _final_sql(kind: str, word: str) -> str:
    return f"""
select o.id as order_id, coalesce(c.status, o.status, 'Draft') as status
from {kind}_order o left join (select order_id, max_by(new_status, seq) as status from ({_sequence_sql(kind, word)}) x group by order_id) c
on c.order_id = o.id"""


@query("illegal_transitions_sales", sql=_illegal_sql("sales", "Delivered"))
def q_illegal_transitions_sales(m: Model):
    """E12 for sales orders: commands not offered from the status at that point."""
    return changes.illegal_transitions(m.sales_order.select("id", "status"), order_command(m, "sales"), "sales")


@query("illegal_transitions_purchase", sql=_illegal_sql("purchase", "Received"))
def q_illegal_transitions_purchase(m: Model):
    """E12 for purchase orders."""
    return changes.illegal_transitions(m.purchase_order.select("id", "status"), order_command(m, "purchase"), "purchase")


@query("final_status_sales", sql=_final_sql("sales", "Delivered"))
def q_final_status_sales(m: Model):
    """E8 for sales orders: the last command wins, deliveries with the status they led to."""
    return changes.final_status(m.sales_order.select("id", "status"), order_command(m, "sales"))


@query("final_status_purchase", sql=_final_sql("purchase", "Received"))
def q_final_status_purchase(m: Model):
    """E8 for purchase orders."""
    return changes.final_status(m.purchase_order.select("id", "status"), order_command(m, "purchase"))


@query("load_users_merge_fields", sql="""
select coalesce(s.id, u.id) as id, coalesce(s.name, u.name) as name, coalesce(s.email, u.email) as email, coalesce(s.role, u.role) as role
from app_user u full outer join (
  select lower(email) as k, max_by(email, pos) as email, max_by(id, case when pos >= 100 then pos end) as id,
         max_by(name, case when pos >= 100 then pos end) as name, max_by(role, case when pos >= 100 or pos % 2 = 0 then pos end) as role
  from saved_user group by lower(email)) s on lower(u.email) = s.k""")
def q_load_users_merge_fields(m: Model):
    """A7 with absent fields: re-saved users carry their e-mail and every second one a role; the rest stays."""
    every = F.array(*[F.lit(c) for c in ("id", "name", "email", "role")])
    some = F.when(F.col("pos") >= 100, every).when(F.col("pos") % 2 == 0, F.array(F.lit("email"), F.lit("role"))).otherwise(F.array(F.lit("email")))
    saved = saved_users(m).withColumn("carried", some)
    return changes.load_users_merge(m.app_user, saved, present="carried").select("id", "name", "email", "role")


@query("search_boms", sql="""
select b.id, b.reference, p.product_name as finished_product_name from bom b join product p on p.product_id = b.finished_product_id
where contains(lower(b.reference), 'gear') or contains(lower(p.product_name), 'gear')""")
def q_search_boms(m: Model):
    """BoM search for 'Gear' over reference and finished product."""
    names = m.product.select(F.col("product_id").alias("finished_product_id"), F.col("product_name").alias("finished_product_name"))
    view = boms(m).join(names, "finished_product_id")
    return search.search(view, "boms", "Gear").select("id", "reference", "finished_product_name")


@query("search_purchase", sql="""
select o.id, concat('PO-', lpad(cast(o.id as varchar), 6, '0')) as reference, v.vendor_name, o.status
from purchase_order o left join vendor v on v.id = o.vendor_id
where (contains(concat('po-', lpad(cast(o.id as varchar), 6, '0')), '00001') or coalesce(contains(lower(v.vendor_name), '00001'), false))
  and o.status = 'Fully Received'""")
def q_search_purchase(m: Model):
    """Purchase search for '00001' (reference or vendor) with status Fully Received."""
    names = m.vendor.select(F.col("id").alias("vendor_id"), "vendor_name")
    view = (m.purchase_order.withColumn("reference", F.concat(F.lit("PO-"), F.lpad(F.col("id").cast("string"), 6, "0")))
            .join(names, "vendor_id", "left"))
    return search.search(view, "purchase", "00001", "Fully Received").select("id", "reference", "vendor_name", "status")


@query("search_manufacturing", sql="""
select mo.id, p.product_name as finished_product_name, mo.status
from manufacturing_order mo left join product p on p.product_id = mo.finished_product_id
where mo.status = 'Done' and coalesce(contains(lower(p.product_name), 'blue'), false)""")
def q_search_manufacturing(m: Model):
    """Manufacturing search for 'BLUE' in the finished product with status Done."""
    names = m.product.select(F.col("product_id").alias("finished_product_id"), F.col("product_name").alias("finished_product_name"))
    view = m.manufacturing_order.join(names, "finished_product_id", "left")
    return search.search(view, "manufacturing", "BLUE", "Done").select("id", "finished_product_name", "status")


@query("enrich_purchase_lines", sql="""
select l.order_id, l.line_seq, l.product_id, p.product_name, 'Units' as unit, p.cost_price as unit_price,
       cast(p.cost_price * l.ordered_qty as decimal(20,2)) as total
from purchase_line l join product p on p.product_id = l.product_id""")
def q_enrich_purchase_lines(m: Model):
    """C1 for purchase lines: names, unit, cost price and booked total."""
    out, _ = lines.enrich_lines(m.purchase_line, m.product, "purchase")
    return out.select("order_id", "line_seq", "product_id", "product_name", "unit", "unit_price", "total")


@query("product_documents", sql="""
select product_id, '{"product_id":' || cast(product_id as varchar) || ',"reference":"' || reference || '","procurement_type":' ||
       coalesce('"' || procurement_type || '"', 'null') || '}' as document from product""")
def q_product_documents(m: Model):
    """Every product as a JSON object, nulls kept."""
    from stockflow.functions.scalars import to_document
    return m.product.select("product_id", to_document("product_id", "reference", "procurement_type").alias("document"))


@query("compact_changes_with_base", sql="""
with all_rows as (
  select record_id, seq, op, new_value, new_label from change_feed
  union all select product_id, -4611686018427387904, 'create', on_hand_qty, product_name from product),
g as (
  select record_id, max(case when op = 'create' then seq end) as last_create, max(case when op = 'delete' then seq end) as last_delete,
         max(case when op in ('create', 'update') then seq end) as last_seq, max(case when new_value is not null then seq end) as vseq
  from all_rows group by record_id)
select g.record_id, case when g.vseq >= g.last_create then f.new_value end as new_value, fl.new_label,
       case when g.last_seq > -4611686018427387904 then g.last_seq end as last_seq
from g left join all_rows f on f.record_id = g.record_id and f.seq = g.vseq
left join all_rows fl on fl.record_id = g.record_id and fl.seq = g.last_seq
where g.last_create is not null and (g.last_delete is null or g.last_create > g.last_delete)""")
def q_compact_changes_with_base(m: Model):
    """E7 on top of existing records: products that the feed then updates and deletes."""
    base = m.product.select(F.col("product_id").alias("record_id"), F.col("on_hand_qty").alias("new_value"), F.col("product_name").alias("new_label"))
    return changes.compact_changes(m.change_feed, "record_id", keep_cols=["new_value"], overlay_cols=["new_label"], base=base)


@query("assign_references", sql="""
select id, creation_date, cast(999 + row_number() over (order by creation_date, id) as bigint) as new_id,
       concat('SO-', lpad(cast(1000 + row_number() over (order by creation_date, id) as varchar), 6, '0')) as reference
from sales_order""")
def q_assign_references(m: Model):
    """Number sales orders by (creation date, id) from 1000 with references SO-<new_id + 1>."""
    return changes.assign_references(m.sales_order.select("id", "creation_date"), "SO", 1000,
                                     ["creation_date", "id"])


@query("next_ids", sql="""
select 'sales' as kind, greatest(1, coalesce(max(id) + 1, 1)) as next_id from sales_order
union all select 'purchase', greatest(1, coalesce(max(id) + 1, 1)) from purchase_order
union all select 'manufacturing', greatest(1, coalesce(max(id) + 1, 1)) from manufacturing_order""")
def q_next_ids(m: Model):
    """Next id per order table."""
    return (changes.next_ids(m.sales_order).select(F.lit("sales").alias("kind"), "next_id")
            .unionByName(changes.next_ids(m.purchase_order).select(F.lit("purchase").alias("kind"), "next_id"))
            .unionByName(changes.next_ids(m.manufacturing_order)
                         .select(F.lit("manufacturing").alias("kind"), "next_id")))


@query("load_users_merge", sql="""
select coalesce(s.id, u.id) as id, coalesce(s.name, u.name) as name,
       case when s.email is not null then s.email else u.email end as email,
       case when s.email is not null then s.role else u.role end as role
from app_user u full outer join (
  select lower(email) as k, max_by(id, pos) as id, max_by(name, pos) as name, max_by(email, pos) as email,
         max_by(role, pos) as role from saved_user group by lower(email)) s
on lower(u.email) = s.k""")
def q_load_users_merge(m: Model):
    """Saved users overlay base users by e-mail (any case); unmatched saved users are appended."""
    return changes.load_users_merge(m.app_user, saved_users(m)).select("id", "name", "email", "role")


@query("load_permissions_merge", sql="""
select user_id, module, can_view from permission
union all
select r.r_regionkey + 100, mm.module, 'Full' from region r cross join (values ('Sales'), ('Audit')) as mm(module)""")
def q_load_permissions_merge(m: Model):
    """Saved permission rows inserted only where (user, module) is new; base wins."""
    return changes.load_permissions_merge(m.permission, saved_permissions(m))


# --------------------------------------------------------------------------
# Users and permissions
# --------------------------------------------------------------------------


@query("public_users", sql="select id, name, email, role from app_user")
def q_public_users(m: Model):
    """B1: user fields allow-list."""
    return access.public_users(m.app_user)


_CAN_SQL = """
select u.id as user_id, mm.module,
       (u.role = 'Admin' or coalesce(p.can_view <> 'None', false)) as allowed
from app_user u
cross join (values ('Sales'), ('Purchase'), ('Manufacturing'), ('Product'), ('BoM'), ('Audit'), ('User')) as mm(module)
left join permission p on p.user_id = u.id and p.module = mm.module"""


@query("can_view", sql=_CAN_SQL)
def q_can_view(m: Model):
    """May each user view each module."""
    return access.can(m.app_user, m.permission, "view")


@query("visible_views", sql="""
select c.user_id, v.view_id, v.label from (values ('dashboard', 'Dashboard', 'Dashboard'), ('sales', 'Sale Orders', 'Sales'),
   ('purchase', 'Purchase Orders', 'Purchase'), ('manufacturing', 'Manufacturing Orders', 'Manufacturing'),
   ('boms', 'Bills of Materials', 'BoM'), ('products', 'Products', 'Product'), ('stock', 'Stock Ledger', 'Product'),
   ('audit', 'Audit Logs', 'Audit'), ('users', 'User Management', 'User')) as v(view_id, label, module)
join (select id as user_id from app_user) c on true
left join (""" + _CAN_SQL + """) k on k.user_id = c.user_id and k.module = v.module
where v.module = 'Dashboard' or coalesce(k.allowed, false)""")
def q_visible_views(m: Model):
    """Navigation views each user sees."""
    return access.visible_views(m.app_user, m.permission)


@query("admin_permissions", sql="""
select u.id as user_id, mm.module, 'Full' as can_view, 'Full' as can_create, 'Full' as can_edit, 'Full' as can_delete
from app_user u cross join (values ('Sales'), ('Purchase'), ('Manufacturing'), ('Product'), ('BoM'), ('Audit'), ('User')) as mm(module)
where u.role = 'Admin'""")
def q_admin_permissions(m: Model):
    """Full on every module for admins."""
    return access.admin_permissions(m.app_user)


@query("permission_matrix", sql="""
select u.user_id, mm.module, lvl as can_view, lvl as can_create, lvl as can_edit,
       case when mm.module = 'Audit' then 'None' when lvl = 'Full' then 'Limited' else 'None' end as can_delete
from """ + _CREATED_ALLOWED_SQL + """ u
cross join (values ('Sales'), ('Purchase'), ('Manufacturing'), ('Product'), ('BoM'), ('Audit'), ('User')) as mm(module)
cross join lateral (select case when exists (select 1 from audit_log a where a.user_id = u.user_id
    and a.action = 'Created' and a.module = mm.module) then 'Full' else 'None' end as lvl) l""")
def q_permission_matrix(m: Model):
    """Seven permission rows per user from the modules they may use (here: modules they created records in)."""
    return _matrix_from_audit(m)


@query("permissions_for_email", sql="""
select u.id as user_id, mm.module, 'Full' as can_view, 'Full' as can_create, 'Full' as can_edit, 'Limited' as can_delete
from app_user u cross join (values ('Sales'), ('BoM')) as mm(module)
where lower(trim(u.email)) = 'nation_6@example.test'""")
def q_permissions_for_email(m: Model):
    """Permission rows for the user with a given e-mail (any case)."""
    return access.permissions_for_email(m.app_user, " Nation_6@Example.test ", ["Sales", "BoM"],
                                        ["Full", "Full", "Full", "Limited"])


@query("permissions_by_user", sql="""
select user_id, count(*) as module_count, string_agg(module || ':' || can_view, ',' order by module) as modules
from permission group by user_id""")
def q_permissions_by_user(m: Model):
    """Permission rows grouped per user."""
    g = access.permissions_by_user(m.permission)
    return g.select("user_id", F.size("permissions").cast("bigint").alias("module_count"),
                    F.array_join(F.transform("permissions", lambda x: F.concat(x["module"], F.lit(":"), x["can_view"])),
                                 ",").alias("modules"))


@query("duplicate_emails", sql="""
select s.id, s.email from saved_user s where exists (select 1 from app_user u where lower(u.email) = lower(s.email))""")
def q_duplicate_emails(m: Model):
    """Incoming users whose e-mail already exists in any case."""
    return access.duplicate_emails(m.app_user, saved_users(m)).select("id", "email")


@query("unsold_products", sql="""
select p.product_id, p.reference from product p
where not exists (select 1 from sales_line l join sales_order o on o.id = l.order_id
                  where l.product_id = p.product_id and o.status = 'Cancelled')""")
def q_unsold_products(m: Model):
    """Products on no line of a cancelled order (anti join)."""
    cancelled = m.sales_order.filter(F.col("status") == "Cancelled").select(F.col("id").alias("order_id"))
    lost = access.exists_in(m.sales_line, cancelled, ["order_id"])
    return access.not_in(m.product.select("product_id", "reference"), lost, ["product_id"])


@query("access_denied", sql="""
select a.id, a.user_id, a.module from audit_log a
where not exists (select 1 from (""" + _CAN_SQL + """) k where k.user_id = a.user_id and k.module = a.module and k.allowed)""")
def q_access_denied(m: Model):
    """K5: requests (audit events by user and module) that the permission check refuses."""
    return access.access_denied(m.audit_log.select("id", "user_id", "module"), m.app_user, m.permission)


# --------------------------------------------------------------------------
# Integrity rules (H1-H7, H9) and procurement (K2)
# --------------------------------------------------------------------------


@query("violations", sql="""
select 'unique' as rule, 'lineitem' as table_name,
       concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar)) as key,
       'count=' || cast(count(*) as varchar) as detail
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all
select 'unique', 'product', reference, 'count=' || cast(count(*) as varchar) from product group by reference having count(*) > 1
union all
select 'foreign_key', 'sales_line', concat_ws('|', cast(order_id as varchar), cast(line_seq as varchar)),
       'product_id=' || cast(product_id as varchar)
from sales_line l where product_id is not null and not exists (select 1 from product p where p.product_id = l.product_id)
union all
select 'foreign_key', 'sales_order', cast(id as varchar), 'o_custkey=' || cast(o_custkey as varchar)
from sales_order o where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey)
union all
select 'foreign_key', 'purchase_order', cast(id as varchar), 'vendor_id=' || cast(vendor_id as varchar)
from purchase_order o where vendor_id is not null and not exists (select 1 from vendor v where v.id = o.vendor_id)
union all
select 'domain', 'purchase_order', cast(id as varchar), 'status=' || status from purchase_order
where status is not null and status not in ('Draft', 'Confirmed', 'Partially Received', 'Fully Received', 'Cancelled')
union all
select 'domain', 'audit_log', cast(id as varchar), 'action=' || action from audit_log
where action is not null and action not in ('Created', 'Updated', 'Deleted', 'Status Changed')
union all
select 'not_null', 'purchase_order', cast(id as varchar), 'vendor_id' from purchase_order where vendor_id is null
union all
select 'not_null', 'purchase_order', cast(id as varchar), 'creation_date' from purchase_order where creation_date is null
union all
select 'length', 'app_user', cast(id as varchar), 'name length=' || cast(length(name) as varchar) from app_user where length(name) > 8
union all
select 'precision', 'customer', cast(c_custkey as varchar), 'c_acctbal not decimal(12,2)' from customer
where c_acctbal is not null and (try_cast(c_acctbal as decimal(12,2)) is null
      or cast(try_cast(c_acctbal as decimal(12,2)) as double) <> c_acctbal)
union all
select 'required', 'app_user', cast(id as varchar), 'name' from app_user where name is null or trim(name) = ''
union all
select 'required', 'app_user', cast(id as varchar), 'email' from app_user where email is null or trim(email) = ''""")
def q_violations(m: Model):
    """H1-H6, H9: integrity rules of the schema as one violations frame."""
    q = quality
    return q.violations([
        q.check_unique(m.raw("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]),
        q.check_unique(m.product, "product", ["reference"]),
        q.check_foreign_key(m.sales_line, "sales_line", ["product_id"], m.product, ["product_id"],
                            ["order_id", "line_seq"]),
        q.check_foreign_key(m.sales_order, "sales_order", ["o_custkey"], m.raw("customer"), ["c_custkey"], ["id"]),
        q.check_foreign_key(m.purchase_order, "purchase_order", ["vendor_id"], m.vendor, ["id"], ["id"]),
        q.check_domain(m.purchase_order, "purchase_order", "status",
                       ["Draft", "Confirmed", "Partially Received", "Fully Received", "Cancelled"], ["id"]),
        q.check_domain(m.audit_log, "audit_log", "action", ["Created", "Updated", "Deleted", "Status Changed"], ["id"]),
        q.check_not_null(m.purchase_order, "purchase_order", ["vendor_id", "creation_date"], ["id"]),
        q.check_length(m.app_user, "app_user", "name", 8, ["id"]),
        q.check_precision(m.raw("customer"), "customer", "c_acctbal", 12, 2, ["c_custkey"]).withColumn(
            "detail", F.lit("c_acctbal not decimal(12,2)")),
        q.check_required(m.app_user, "app_user", ["name", "email"], ["id"]),
    ])


@query("cascade_delete", sql="""
select order_id, line_seq from sales_line where order_id in (select id from sales_order where status <> 'Cancelled')""")
def q_cascade_delete(m: Model):
    """H7: sales lines left after deleting the cancelled orders with ON DELETE CASCADE."""
    remaining = m.sales_order.filter(F.col("status") != "Cancelled")
    return quality.cascade_delete(m.sales_line.select("order_id", "line_seq"), remaining, "order_id")


@query("entity_violations", sql=entity_rules.violations_sql())
def q_entity_violations(m: Model):
    """H1-H6, H9: every rule of the schema over all entity tables that the given tables hold."""
    checks = [quality.check_precision(m.raw(t), t, c, p, s, key) for t, c, p, s, key in entity_rules.PRECISION]
    return quality.violations([quality.entity_violations(entity_rules.entities(m)), *checks])


@query("cascade_delete_all", sql=entity_rules.cascade_sql())
def q_cascade_delete_all(m: Model):
    """H7: children left in all seven child tables after deleting some parents of each kind."""
    tables = entity_rules.entities(m)
    left = {t: tables[t].filter(~F.coalesce(F.expr(gone), F.lit(False))) for t, gone in entity_rules.DELETED.items()}
    return quality.cascade_delete_all(tables, left)


@query("orphans", sql="""
select order_id, line_seq from sales_line l where not exists (
  select 1 from sales_order o where o.id = l.order_id and o.status <> 'Cancelled')""")
def q_orphans(m: Model):
    """H7 (reference behaviour): lines whose order was deleted stay behind as orphans."""
    remaining = m.sales_order.filter(F.col("status") != "Cancelled")
    return quality.orphans(m.sales_line.select("order_id", "line_seq"), remaining, "order_id")


_NEED_SQL = """
with sh as (
  select order_id, line_seq, product_id,
         least(outstanding_qty, greatest(cum - greatest(on_hand_qty, 0), 0)) as short_qty
  from (select l.order_id, l.line_seq, l.product_id, p.on_hand_qty,
               greatest(l.ordered_qty - l.done_qty, 0) as outstanding_qty,
               sum(greatest(l.ordered_qty - l.done_qty, 0)) over (partition by l.product_id
                   order by o.creation_date, l.order_id, l.line_seq rows between unbounded preceding and current row) as cum
        from sales_line l join sales_order o on o.id = l.order_id
        left join product p on p.product_id = l.product_id
        where o.status in ('Confirmed', 'Partially Delivered')) x),
need as (
  select s.order_id, s.product_id, cast(sum(s.short_qty) as decimal(20,3)) as quantity,
         max(p.procurement_type) as procurement_type, max(p.vendor_id) as vendor_id, max(p.bom_id) as bom_id
  from sh s join product p on p.product_id = s.product_id
  where s.short_qty > 0 and coalesce(p.procure_on_demand, false)
  group by s.order_id, s.product_id)
"""


def _plan(m: Model):
    sh = stock.shortages(m.sales_order, m.sales_line, m.product)
    return procurement.procurement_plan(sh, m.product, m.bom_component)


@query("procurement_purchase_lines", sql=_NEED_SQL + """
select order_id as source_order_id, vendor_id, product_id, quantity, 'Draft' as status,
       concat('SO-', lpad(cast(order_id + 1 as varchar), 6, '0')) as source_note
from need where procurement_type = 'Purchase'""")
def q_procurement_purchase_lines(m: Model):
    """K2: draft purchase lines per (short order, vendor, product) for purchase-on-demand products."""
    return _plan(m)["purchase_lines"]


@query("procurement_manufacturing_orders", sql=_NEED_SQL + """
select order_id as source_order_id, product_id as finished_product_id, bom_id, quantity, 'Draft' as status,
       concat('SO-', lpad(cast(order_id + 1 as varchar), 6, '0')) as source_note
from need where procurement_type = 'Manufacturing'""")
def q_procurement_manufacturing_orders(m: Model):
    """K2: draft manufacturing orders per (short order, product) for make-on-demand products."""
    return _plan(m)["manufacturing_orders"]


@query("procurement_mo_components", sql=_NEED_SQL + """
select concat_ws('-', cast(n.order_id as varchar), cast(n.product_id as varchar)) as mo_id,
       bc.component_product_id as product_id,
       cast(bc.to_consume_qty * coalesce(nullif(n.quantity, 0), 1) as decimal(20,3)) as to_consume_qty,
       cast(0 as decimal(20,3)) as consumed_qty
from need n join bom_component bc on bc.bom_id = n.bom_id where n.procurement_type = 'Manufacturing'""")
def q_procurement_mo_components(m: Model):
    """K2 + C6: components of the draft manufacturing orders."""
    return _plan(m)["mo_components"]


# --------------------------------------------------------------------------
# Streaming (I1, I2), documents and snapshots
# --------------------------------------------------------------------------


@query("stream_on_hand", sql="""
select m.product_id, cast(coalesce(max(p.on_hand_qty), 0) + sum(m.movement_qty) as decimal(20,3)) as on_hand_qty
from stock_movement m left join product p on p.product_id = m.product_id group by m.product_id""")
def q_stream_on_hand(m: Model):
    """On hand per product from the lineitem file stream; a micro-batch adds a run of its own net movements."""
    base = os.path.join(checkpoint_dir(m.spark), "streams", f"on-hand-{uuid.uuid4().hex[:8]}")
    net = folds.fold_on_hand(streams.movement_stream(read_stream(m, "lineitem")), base).read()
    return streams.on_hand_from_net(net.select("product_id", F.col("net").cast("decimal(20,3)").alias("net_qty")),
                                    m.product.select("product_id", "on_hand_qty"))


@query("stream_audit_counts", sql="""
select count(*) as total, count(*) filter (where action = 'Created') as created,
       count(*) filter (where action = 'Updated') as updated, count(*) filter (where action = 'Deleted') as deleted
from audit_log""")
def q_stream_audit_counts(m: Model):
    """Running audit counts from the events file stream."""
    path = streams.run_to_table(streams.stream_audit_counts(audit_stream(m)), "audit_counts", m.spark)
    return streams.latest(m.spark, path, [])


@query("snapshot_roundtrip", sql="select cast(id as bigint) as id, name, email, role from app_user")
def q_snapshot_roundtrip(m: Model):
    """A4 + A1: users and permissions written as a snapshot and read back with a fixed schema."""
    path = os.path.join(checkpoint_dir(m.spark), "snapshots", uuid.uuid4().hex[:8])
    documents.write_snapshot(m.app_user, m.permission, path)
    users, _ = documents.read_snapshot(m.spark, path)
    return users.select("id", "name", "email", "role")


@query("summary_json_roundtrip", sql="""
select b.id, (select count(*) from bom_component c where c.bom_id = b.id) as component_count,
       (select count(*) from bom_operation o where o.bom_id = b.id) as operation_count
from bom b join product p on p.product_id = b.finished_product_id""")
def q_summary_json_roundtrip(m: Model):
    """A5: nested BoM documents written as JSON lines and read back."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    path = os.path.join(checkpoint_dir(m.spark), "summaries", uuid.uuid4().hex[:8])
    documents.write_summary_json(doc, path)
    back = m.spark.read.schema(doc.schema).json(path)
    return back.select("id", F.size("components").cast("bigint").alias("component_count"),
                       F.size("operations").cast("bigint").alias("operation_count"))


@query("reference_bundle_products", sql="""
select p.product_id, p.reference, s.reserved_qty, s.free_qty from product p
left join position_sales s on s.product_id = p.product_id""")
def q_reference_bundle_products(m: Model):
    """The products lookup of the reference bundle, with reserved and free from D1/D3."""
    b = documents.reference_bundle(m.product, _position_sales(m), m.vendor, boms(m), m.app_user)
    return b["products"].select("product_id", "reference", "reserved_qty", "free_qty")


# --------------------------------------------------------------------------
# Scalar functions
# --------------------------------------------------------------------------


@query("scalar_functions", sql="""
select id, 'SO-' || lpad(cast(user_id as varchar), 6, '0') as ref,
       substring(cast(date_time as varchar), 1, 10) as day,
       length(record_id) as record_len,
       coalesce(contains(record_id, '0001'), false) as has_0001,
       coalesce(contains(lower(module), 'sal'), false) as module_sal,
       greatest(user_id - 50, 0) as above_50,
       least(user_id, 100) as capped_100,
       lower(trim(' ' || module || '@Example.TEST ')) as email,
       case when user_id % 5 = 0 then 'none' else module end as or_default_text,
       cast(date '1998-07-01' + 30 as date) as due
from audit_log""")
def q_scalar_functions(m: Model):
    """G1, G4-G8, G12, G13 applied to every audit row."""
    from stockflow.functions import scalars as S
    a = m.audit_log
    return a.select(
        "id", S.reference_code("SO", F.col("user_id")).alias("ref"),
        S.date_only(F.col("date_time")).alias("day"),
        S.char_length("record_id").cast("bigint").alias("record_len"),
        S.contains("record_id", "0001").alias("has_0001"),
        S.contains_ci("module", "SAL").alias("module_sal"),
        S.at_least(F.col("user_id") - 50, 0).alias("above_50"),
        S.at_most("user_id", 100).alias("capped_100"),
        S.norm_email(F.concat(F.lit(" "), F.col("module"), F.lit("@Example.TEST "))).alias("email"),
        S.or_default(F.when(F.col("user_id") % 5 != 0, F.col("module")).otherwise(F.lit("")), "none", "text")
        .alias("or_default_text"),
        S.add_days(AS_OF, 30).alias("due"))


@query("coerce_values", sql="""
select event_id, kind, case when kind = 'text' then v end as text,
       case when kind = 'number' then try_cast(trim(v) as double) end as number,
       case when kind = 'boolean' then v = 'true' end as flag
from (select event_id, v,
             case when v is null or v = '' then 'null' when v in ('true', 'false') then 'boolean'
                  when regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                       and not contains(k, 'date') and k not in ('password', 'email') then 'number'
                  else 'text' end as kind
      from (select event_id, event_type as k,
                   case event_type when 'view' then '' when 'signup' then 'true' when 'error' then props
                                   when 'click' then cast(user_id as varchar) else ' ' || cast(user_id as varchar) || 'x' end as v
            from events) r) s""")
def q_coerce_values(m: Model):
    """Form values coerced to null / boolean / number / text."""
    from stockflow.functions import scalars as S
    e = m.raw("events")
    et = F.col("event_type")
    v = (F.when(et == "view", F.lit("")).when(et == "signup", F.lit("true")).when(et == "error", F.col("props"))
          .when(et == "click", F.col("user_id").cast("string"))
          .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("x"))))
    c = e.select("event_id", S.coerce_value(et, v).alias("c"))
    return c.select("event_id", "c.kind", "c.text", "c.number", "c.flag")


@query("clean_text", sql="""
select product_id, substring(trim(regexp_replace(regexp_replace('<b>' || product_name || '</b>' || chr(160) || ' end ',
       '[<>]', '', 'g'), '[\\s\\p{Z}\\x{FEFF}]+', ' ', 'g')), 1, 30) as cleaned
from product""")
def q_clean_text(m: Model):
    """Strip angle brackets, collapse white space (incl. no-break space), trim, cut to 30."""
    from stockflow.functions import scalars as S
    raw = F.concat(F.lit("<b>"), F.col("product_name"), F.lit("</b>\u00a0 end "))
    return m.product.select("product_id", S.clean_text(raw, 30).alias("cleaned"))


# --------------------------------------------------------------------------
# Product normalisation, predicate updates, vendor copy, append, flatten
# (B2, B6, C3, F4, F6)
# --------------------------------------------------------------------------


@query("normalise_products", sql="""
select product_id, reference,
       cast(case when on_hand_qty is null or on_hand_qty = 0 then 0 else on_hand_qty end as decimal(14,3)) as on_hand_qty,
       cast(0 as decimal(14,3)) as reserved_qty,
       cast(case when on_hand_qty is null or on_hand_qty = 0 then 0 else on_hand_qty end as decimal(15,3)) as free_to_use_qty,
       'Units' as unit, coalesce(procure_on_demand, false) as procure_on_demand,
       case when procurement_type is null or procurement_type = '' then '' else procurement_type end as procurement_type,
       case when vendor_id is null or vendor_id = 0 then null else vendor_id end as vendor_id,
       case when bom_id is null or bom_id = 0 then null else bom_id end as bom_id
from product""")
def q_normalise_products(m: Model):
    """B2: product rows with the creation defaults applied."""
    raw = m.product.select("product_id", "reference", "on_hand_qty", "procure_on_demand", "procurement_type",
                           "vendor_id", "bom_id")
    return lines.normalise_products(raw)


@query("set_where", sql="""
select product_id,
       case when vendor_id in (1, 2) or product_id = 7 then true else procure_on_demand end as procure_on_demand,
       case when vendor_id in (1, 2) or product_id = 7 then 'Purchase' else procurement_type end as procurement_type
from product""")
def q_set_where(m: Model):
    """UPDATE products SET procure flag and type WHERE vendor in (1, 2) or id = 7."""
    pred = F.col("vendor_id").isin(1, 2) | (F.col("product_id") == 7)
    out = lines.set_where(m.product, pred, {"procure_on_demand": True, "procurement_type": "Purchase"})
    return out.select("product_id", "procure_on_demand", "procurement_type")


@query("with_vendor", sql="""
select o.id, o.vendor_id, v.vendor_name, v.vendor_address, o.status
from purchase_order o left join vendor v on v.id = o.vendor_id""")
def q_with_vendor(m: Model):
    """Purchase orders with the vendor's name and address copied on."""
    return lines.with_vendor(m.purchase_order, m.vendor).select("id", "vendor_id", "vendor_name",
                                                                 "vendor_address", "status")


@query("append_draft_purchase_orders", sql=_NEED_SQL + """,
drafts as (select distinct order_id, vendor_id from need where procurement_type = 'Purchase'),
nxt as (select greatest(1, coalesce(max(id) + 1, 1)) as start from purchase_order)
select id, vendor_id, status, null as reference, null as source_note from purchase_order
union all
select d.start + row_number() over (order by order_id, vendor_id) - 1, vendor_id, 'Draft',
       concat('PO-', lpad(cast(d.start + row_number() over (order by order_id, vendor_id) as varchar), 6, '0')),
       concat('SO-', lpad(cast(order_id + 1 as varchar), 6, '0'))
from drafts cross join nxt d""")
def q_append_draft_purchase_orders(m: Model):
    """K2 + D18 + E9 + F4: draft purchase orders per (short order, vendor), numbered after the
    last purchase order and appended to the purchase order list."""
    from stockflow.functions.scalars import reference_code
    plan = _plan(m)["purchase_lines"]
    drafts = plan.select("source_order_id", "vendor_id").distinct()
    numbered = changes.assign_references(drafts, "PO", changes.next_ids(m.purchase_order), ["source_order_id", "vendor_id"])
    new = numbered.select(F.col("new_id").alias("id"), "vendor_id", F.lit("Draft").alias("status"),
                          "reference", reference_code("SO", F.col("source_order_id") + 1).alias("source_note"))
    return lines.append_rows(m.purchase_order.select("id", "vendor_id", "status"), new)


@query("flatten_bom_components", sql="""
select b.id, c.component_product_id, cp.product_name as component_name, c.to_consume_qty
from bom b join product p on p.product_id = b.finished_product_id
join bom_component c on c.bom_id = b.id
left join product cp on cp.product_id = c.component_product_id""")
def q_flatten_bom_components(m: Model):
    """nested BoM documents flattened back to one row per component."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    return lines.flatten(doc, "components", keep=["id"])


@query("feed_audit_rows", sql="""
select x.seq, 'Product' as module, 'Product' as record_type, cast(x.record_id as varchar) as record_id,
       case x.op when 'create' then 'Created' when 'update' then 'Updated' else 'Deleted' end as action,
       case when x.op = 'update' then 'details' else '' end as field_changed,
       case when x.op = 'delete' then coalesce(p.new_label, '') else '' end as old_value,
       case x.op when 'create' then coalesce(x.new_label, '') when 'update' then 'Product updated' else '' end as new_value
from (select *, max(case when op = 'create' then seq end) over w as pc,
             max(case when op = 'delete' then seq end) over w as pd,
             max(case when op in ('create', 'update') then seq end) over w as pw
      from change_feed window w as (partition by record_id order by seq rows between unbounded preceding and 1 preceding)) x
left join change_feed p on p.record_id = x.record_id and p.seq = x.pw
where x.op = 'create' or (x.pc is not null and (x.pd is null or x.pc > x.pd))""")
def q_feed_audit_rows(m: Model):
    """E10 for the change feed: Created / Updated / Deleted audit rows for applied changes only."""
    return changes.feed_audit_rows(m.change_feed, "record_id", "Product", "Product", "new_label",
                                   "Product updated")


@query("bom_texts", sql="""
select b.id,
       coalesce((select string_agg(coalesce(cp.product_name, '') || ' x ' || cast(c.to_consume_qty as varchar), ', '
                                   order by c.component_product_id, cp.product_name, c.to_consume_qty)
                 from bom_component c left join product cp on cp.product_id = c.component_product_id
                 where c.bom_id = b.id), '') as component_text,
       coalesce((select string_agg(o.operation_name || ' ' || cast(o.expected_duration as varchar) || 'm', ', '
                                   order by o.operation_name, o.work_center, o.expected_duration)
                 from bom_operation o where o.bom_id = b.id), '') as operation_text
from bom b join product p on p.product_id = b.finished_product_id""")
def q_bom_texts(m: Model):
    """D16: 'name x qty' per component and 'name <minutes>m' per operation, joined per BoM."""
    doc = summaries.bom_summary(boms(m), m.bom_component, m.bom_operation, m.product, flat=False)
    return doc.select("id", search.component_text("components").alias("component_text"),
                      search.operation_text("operations").alias("operation_text"))


@query("patch_rejects", sql="""
select user_id as product_id, event_id as seq, 'not found' as error from events e
where not exists (select 1 from product p where p.product_id = e.user_id and p.procure_on_demand)""")
def q_patch_rejects(m: Model):
    """Product edits for products that are not in the on-demand list."""
    return changes.patch_rejects(m.product.filter("procure_on_demand").select("product_id"), product_patch(m), "product_id")


_PRODUCE_SQL = """
with ev as (
  select e.mo_id, e.product_id, e.seq, false as synth,
         least(case when e.requested_qty is null or e.requested_qty = 0 then c.to_consume_qty else e.requested_qty end,
               c.to_consume_qty) as t,
         c.to_consume_qty as need, coalesce(c.consumed_qty, 0) as init
  from produce_explicit e join mo_component c on c.mo_id = e.mo_id and c.product_id = e.product_id
  union all
  select c.mo_id, c.product_id, f.seq, true, c.to_consume_qty, c.to_consume_qty, coalesce(c.consumed_qty, 0)
  from (select mo_id, min(seq) as seq from produce_request where all_components group by mo_id) f
  join mo_component c on c.mo_id = f.mo_id),
s1 as (select *, max(t) over (partition by mo_id, product_id order by seq, synth
                              rows between unbounded preceding and 1 preceding) as pt from ev),
s2 as (select *, case when not synth then t when coalesce(pt, 0) <= 0 and init = 0 then need else 0 end as eff from s1),
s3 as (select *, greatest(init, coalesce(max(eff) over (partition by mo_id, product_id order by seq, synth
                              rows between unbounded preceding and 1 preceding), init)) as before_qty from s2)
"""


@query("produce_movements", sql=_PRODUCE_SQL + """
select mo_id, product_id, seq, cast(-(greatest(before_qty, eff) - before_qty) as decimal(20,3)) as movement_qty,
       'consume' as kind
from s3 where greatest(before_qty, eff) > before_qty
union all
select r.mo_id, mo.finished_product_id, r.seq, cast(mo.quantity as decimal(20,3)), 'finish'
from produce_request r join manufacturing_order mo on mo.id = r.mo_id""")
def q_produce_movements(m: Model):
    """E4 + E5 + E6: produce requests on open MOs - component consumption (a list-less request consumes only
    untouched components) and finished goods per request."""
    comps = _mo_components(m)
    explicit, produce = produce_requests(m, comps)
    return fulfil.produce_orders(m.manufacturing_order, comps, explicit, produce)["movements"]


@query("produce_components_after", sql=_PRODUCE_SQL + """
select c.mo_id, c.product_id, c.to_consume_qty,
       cast(coalesce(a.after_qty, coalesce(c.consumed_qty, 0)) as decimal(20,3)) as consumed_qty
from mo_component c left join (select mo_id, product_id, max(greatest(before_qty, eff)) as after_qty from s3
                               group by mo_id, product_id) a
  on a.mo_id = c.mo_id and a.product_id = c.product_id""")
def q_produce_components_after(m: Model):
    """E4 + E6: MO components with their consumption after the produce requests."""
    comps = _mo_components(m)
    explicit, produce = produce_requests(m, comps)
    return fulfil.produce_orders(m.manufacturing_order, comps, explicit, produce)["components"]


@query("ledger_all", sql=f"""
with sold as ({_movement_sql("sales")}),
bought as ({_movement_sql("purchase")}),
made as ({_PRODUCE_SQL}
  select mo_id, product_id, seq, cast(-(greatest(before_qty, eff) - before_qty) as decimal(20,3)) as movement_qty, 'consume' as kind
  from s3 where greatest(before_qty, eff) > before_qty
  union all
  select r.mo_id, mo.finished_product_id, r.seq, cast(mo.quantity as decimal(20,3)), 'finish'
  from produce_request r join manufacturing_order mo on mo.id = r.mo_id),
moves as (
  select product_id, cmd_time as at, 'deliver' as kind, order_id as source_id, line_seq as item, movement_qty from sold
  union all select product_id, cmd_time, 'receive', order_id, line_seq, movement_qty from bought
  union all select x.product_id, cast(mo.schedule_date as timestamp), x.kind, x.mo_id, x.seq, x.movement_qty
            from made x join manufacturing_order mo on mo.id = x.mo_id)
select m.product_id, m.at, m.kind, m.source_id, m.item, m.movement_qty,
       cast(p.on_hand_qty + sum(m.movement_qty) over (partition by m.product_id order by m.at, m.kind, m.source_id, m.item
            rows between unbounded preceding and current row) as decimal(20,3)) as resulting_on_hand
from moves m left join product p on p.product_id = m.product_id""")
def q_ledger_all(m: Model):
    """E1 over all sources: deliveries, receipts, consumption and finished goods of a product in one running balance."""
    def moves(df, kind):
        return df.select("product_id", F.col("cmd_time").alias("at"), F.lit(kind).alias("kind"), F.col("order_id").alias("source_id"),
                         F.col("line_seq").cast("bigint").alias("item"), "movement_qty")

    comps = _mo_components(m)
    made = fulfil.produce_orders(m.manufacturing_order, comps, *produce_requests(m, comps))["movements"]
    when = m.manufacturing_order.select(F.col("id").alias("mo_id"), F.col("schedule_date").cast("timestamp_ntz").alias("at"))
    produced = made.join(when, "mo_id").select("product_id", "at", "kind", F.col("mo_id").alias("source_id"),
                                               F.col("seq").cast("bigint").alias("item"), "movement_qty")
    everything = (moves(_deliveries(m)["movements"], "deliver").unionByName(moves(_receipts(m)["movements"], "receive"))
                  .unionByName(produced))
    return ledger.ledger(everything, m.product.select("product_id", "on_hand_qty"), ["at", "kind", "source_id", "item"], settle=True)
