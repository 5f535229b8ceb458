"""The Model's tables under the entity names of ``schemas``, and the oracle
SQL of all schema rules over them (H1-H7, H9).

Columns that the given tables don't hold are left out, and the rules on them
with these columns; ``reference_sequences`` has no rows there at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow import schemas as R
from stockflow.operators import bom
from stockflow.sources.model import Model, boms, sales_order_view


# Rows whose entity key the given tables lack take their natural key as id.
ENTITY_SQL = {
    "users": "select id, name, email, role from app_user",
    "user_module_permissions": "select {id:user_id,module}, user_id, module, can_view from permission",
    "vendors": "select id, vendor_name, vendor_address from vendor",
    "products": "select product_id as id, reference, product_name, sales_price, cost_price, on_hand_qty, procure_on_demand, procurement_type, vendor_id, bom_id from product",
    "bills_of_material": "select id, reference, finished_product_id, quantity from bom",
    "bom_components": "select {id:bom_id,component_product_id}, bom_id, component_product_id, to_consume_qty from bom_component",
    "bom_operations": "select {id:bom_id,operation_name}, bom_id, operation_name, work_center, expected_duration from bom_operation",
    "sales_orders": "select id, reference, customer_name, creation_date, due_date, sales_person_id, status from sales_order_view",
    "sales_order_lines": "select {id:order_id,line_seq}, order_id as sales_order_id, product_id, ordered_qty, done_qty as delivered_qty from sales_line",
    "purchase_orders": "select id, vendor_id, creation_date, due_date, responsible_person_id, status from purchase_order",
    "purchase_order_lines": "select {id:order_id,line_seq}, order_id as purchase_order_id, product_id, ordered_qty, done_qty as received_qty from purchase_line",
    "manufacturing_orders": "select id, finished_product_id, quantity, bom_id, schedule_date, assignee_id, status from manufacturing_order",
    "mo_components": "select {id:mo_id,product_id}, mo_id, product_id, to_consume_qty, consumed_qty from mo_component",
    "mo_work_orders": """select {id:mo.id,operation_name}, mo.id as mo_id, operation_name, work_center,
        expected_duration * coalesce(nullif(mo.quantity, 0), 1) as expected_duration, 0 as real_duration, 'Draft' as status
        from manufacturing_order mo join bom_operation bo on bo.bom_id = mo.bom_id""",
    "stock_ledger": "select {id:order_id,line_seq}, product_id, movement_qty, reference_type, order_id as reference_id, movement_date from stock_movement",
    "audit_logs": "select id, date_time, user_id, module, record_type, record_id, action from audit_log",
}

# Raw columns that become the schema's decimals (H6): table, column, precision, scale, key.
PRECISION = [("part", "p_retailprice", 12, 2, ["p_partkey"]), ("customer", "c_acctbal", 12, 2, ["c_custkey"]),
             ("lineitem", "l_quantity", 14, 3, ["l_orderkey", "l_linenumber"])]

# Parents that ``cascade_delete_all`` deletes.
DELETED = {"users": "id % 5 = 1", "bills_of_material": "id % 7 = 0", "sales_orders": "status = 'Cancelled'",
           "purchase_orders": "status = 'Cancelled'", "manufacturing_orders": "status = 'Cancelled'"}

# Rows whose deletion ``delete_outcomes`` is asked for: most documents, so that
# some of what they refer to can go as well.
REQUESTED = {"users": "id % 5 = 1", "vendors": "id % 3 > 0", "products": "id % 2 = 0", "bills_of_material": "id % 4 <> 0",
             "sales_orders": "id % 400 <> 0", "purchase_orders": "id % 300 <> 0", "manufacturing_orders": "id % 200 <> 0",
             "stock_ledger": "reference_id % 500 <> 0", "audit_logs": "id % 50 <> 0"}


def entities(m: Model) -> dict[str, DataFrame]:
    """Entity name -> rows of the given tables."""
    def view(df: DataFrame, cols: str, key: str = "") -> DataFrame:
        out = [F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in key.split()]).alias("id")] if key else []
        for c in cols.split():
            old, _, new = c.partition(">")
            out.append(F.col(old).alias(new or old))
        return df.select(*out)

    return {
        "users": view(m.app_user, "id name email role"),
        "user_module_permissions": view(m.permission, "user_id module can_view", "user_id module"),
        "vendors": view(m.vendor, "id vendor_name vendor_address"),
        "products": view(m.product, "product_id>id reference product_name sales_price cost_price on_hand_qty procure_on_demand "
                                    "procurement_type vendor_id bom_id"),
        "bills_of_material": view(boms(m), "id reference finished_product_id quantity"),
        "bom_components": view(m.bom_component, "bom_id component_product_id to_consume_qty", "bom_id component_product_id"),
        "bom_operations": view(m.bom_operation, "bom_id operation_name work_center expected_duration", "bom_id operation_name"),
        "sales_orders": view(sales_order_view(m), "id reference customer_name creation_date due_date sales_person_id status"),
        "sales_order_lines": view(m.sales_line, "order_id>sales_order_id product_id ordered_qty done_qty>delivered_qty", "order_id line_seq"),
        "purchase_orders": view(m.purchase_order, "id vendor_id creation_date due_date responsible_person_id status"),
        "purchase_order_lines": view(m.purchase_line, "order_id>purchase_order_id product_id ordered_qty done_qty>received_qty", "order_id line_seq"),
        "manufacturing_orders": view(m.manufacturing_order, "id finished_product_id quantity bom_id schedule_date assignee_id status"),
        "mo_components": view(bom.instantiate_components(m.manufacturing_order, m.bom_component),
                              "mo_id product_id to_consume_qty consumed_qty", "mo_id product_id"),
        "mo_work_orders": view(bom.instantiate_operations(m.manufacturing_order, m.bom_operation, scale_duration=True),
                               "mo_id operation_name work_center expected_duration real_duration status", "mo_id operation_name"),
        "stock_ledger": view(m.stock_movement, "product_id movement_qty reference_type order_id>reference_id movement_date", "order_id line_seq"),
        "audit_logs": view(m.audit_log, "id date_time user_id module record_type record_id action"),
    }


def _text(c: str) -> str:
    return f"coalesce(cast({c} as varchar), 'NULL')"


def _ctes() -> str:
    import re
    key = lambda x: "concat_ws('|', " + ", ".join(_text(c) for c in x[1].split(",")) + ") as id"
    return "with " + ",\n".join(f"e_{t} as ({re.sub(r'\{id:([^}]*)\}', key, sql)})" for t, sql in ENTITY_SQL.items())


def _has(t: str, *cols: str) -> bool:
    import re
    return t in ENTITY_SQL and all(re.search(rf"\b{c}\b|\{{{c}:", ENTITY_SQL[t].split(" from ")[0]) for c in cols)


def violations_sql() -> str:
    out = []
    add = lambda rule, t, key, detail, rest: out.append(
        f"select '{rule}' as rule, '{t}' as table_name, {key} as key, {detail} as detail from {rest}")
    for t, keysets in R.UNIQUE.items():
        for ks in keysets:
            if _has(t, *ks):
                add("unique", t, "concat_ws('|', " + ", ".join(_text(k) for k in ks) + ")", "'count=' || cast(count(*) as varchar)",
                    f"e_{t} group by {', '.join(ks)} having count(*) > 1")
    for t, c, parent in R.FOREIGN_KEYS:
        if _has(t, c) and _has(parent, "id"):
            add("foreign_key", t, _text("id"), f"'{c}=' || cast({c} as varchar)",
                f"e_{t} x where {c} is not null and not exists (select 1 from e_{parent} p where p.id = x.{c})")
    for t, c, values in R.DOMAINS:
        if _has(t, c):
            add("domain", t, _text("id"), f"'{c}=' || {c}", f"e_{t} where {c} not in ({', '.join(repr(v) for v in values)})")
    for rule, table in (("not_null", R.NOT_NULL.items()), ("required", R.REQUIRED)):
        for t, cols in table:
            for c in cols:
                if _has(t, c):
                    add(rule, t, _text("id"), f"'{c}'", f"e_{t} where {c} is null" + f" or trim({c}) = ''" * (rule == "required"))
    for t, c, n in R.LENGTH:
        if _has(t, c):
            add("length", t, _text("id"), f"'{c} length=' || cast(length({c}) as varchar)", f"e_{t} where length({c}) > {n}")
    for t, c, p, s, key in PRECISION:
        d = f"decimal({p},{s})"
        add("precision", t, "concat_ws('|', " + ", ".join(_text(k) for k in key) + ")", f"'{c} not {d}: ' || cast({c} as varchar)",
            f"{t} where {c} is not null and (try_cast({c} as {d}) is null or cast(try_cast({c} as {d}) as double) <> {c})")
    return _ctes() + "\n" + "\nunion all\n".join(out)


def cascade_sql() -> str:
    return _ctes() + "\n" + "\nunion all\n".join(
        f"select '{t}' as table_name, {_text('id')} as key from e_{t} where {c} in (select id from e_{p} where not coalesce({DELETED[p]}, false))"
        for t, c, p in R.CASCADE)


def deletes_sql() -> str:
    """Reachability over all references, as a recursive query."""
    restrict = [k for k in R.FOREIGN_KEYS if k not in R.CASCADE and _has(k[0], k[1]) and _has(k[2], "id")]
    down = [k for k in R.CASCADE if _has(k[0], k[1])]
    node = lambda t, x="": f"'{t}' as t, cast({x}id as varchar) as k"
    refs = lambda keys: " union all ".join(
        f"select {node(c)}, '{c}.{col}' as fk, '{p}' as to_t, cast({col} as varchar) as to_k from e_{c} where {col} is not null" for c, col, p in keys)
    asked = " union all ".join(f"select {node(t)} from e_{t} where {rule}" for t, rule in REQUESTED.items())
    return _ctes() + f""",
asked as (select distinct t, k from ({asked}) a),
down as ({refs(down)}),
going as (select t, k, max(asked) as asked from (
  select t, k, true as asked from asked union all
  select d.t, d.k, false from down d join asked a on a.t = d.to_t and a.k = d.to_k) g group by t, k),
held as (select r.*, s.t is not null as going from ({refs(restrict)}) r join going g on g.t = r.to_t and g.k = r.to_k
         left join going s on s.t = r.t and s.k = r.k),
spread as (
  select t, k, to_t, to_k from held where going
  union select d.t, d.k, d.to_t, d.to_k from down d join going a on a.t = d.t and a.k = d.k join going b on b.t = d.to_t and b.k = d.to_k
  union select d.to_t, d.to_k, d.t, d.k from down d join going a on a.t = d.t and a.k = d.k and not a.asked join going b on b.t = d.to_t and b.k = d.to_k),
stays as (select * from (
  with recursive s as (select distinct to_t as t, to_k as k from held where not going
                       union select e.to_t, e.to_k from s join spread e on e.t = s.t and e.k = s.k) select * from s) y),
blocks as (select h.to_t as t, h.to_k as k, min(h.fk) as fk from held h left join stays s on s.t = h.t and s.k = h.k
           where not h.going or s.t is not null group by 1, 2)
select g.t as table_name, g.k as key, case when s.t is not null and g.asked then 'refused' when s.t is not null then 'kept'
       when g.asked then 'deleted' else 'cascaded' end as outcome, b.fk as blocked_by
from going g left join stays s on s.t = g.t and s.k = g.k left join blocks b on b.t = g.t and b.k = g.k"""
