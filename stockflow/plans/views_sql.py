"""The test-table views as SQL text, used as CTEs in every oracle query.

Fixed values: the mapping of FIXTURES.md, so that the DuckDB
oracle and the DataFrame model (stockflow.sources.model) read the same rows.
"""

VIEWS = [
    ("product", "select p_partkey as product_id, concat('PROD-', lpad(cast(p_partkey as string), 6, '0')) as reference, p_name as product_name, cast(p_retailprice as decimal(12,2)) as sales_price, cast(cast(p_retailprice as decimal(12,2)) * 0.6 as decimal(12,2)) as cost_price, cast(p_size * 20 as decimal(14,3)) as on_hand_qty, p_size % 2 = 0 as procure_on_demand, case when p_size % 2 <> 0 then null when p_partkey % 3 = 0 then 'Manufacturing' else 'Purchase' end as procurement_type, p_partkey % 10 as vendor_id, case when p_partkey % 3 = 0 then p_partkey end as bom_id from part"),
    ("vendor", "select s_suppkey as id, s_name as vendor_name, cast(s_nationkey as string) as vendor_address from supplier"),
    ("line", "select l_orderkey as order_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as line_seq, l_partkey as product_id, l_suppkey as vendor_id, l_shipdate, cast(l_quantity as decimal(14,3)) as ordered_qty, cast(case when l_linestatus = 'F' then l_quantity when l_returnflag = 'A' then floor(l_quantity / 2) else 0 end as decimal(14,3)) as done_qty, l_returnflag from lineitem"),
    ("sales_order", "select o_orderkey as id, o_custkey, case when o_orderstatus = 'F' then 'Fully Delivered' when o_orderstatus = 'P' then 'Partially Delivered' when o_orderpriority = '5-LOW' then 'Draft' when o_orderpriority = '4-NOT SPECIFIED' then 'Cancelled' else 'Confirmed' end as status, cast(o_orderdate as date) as creation_date, cast(o_orderdate + interval 30 day as date) as due_date, o_orderkey % 25 as sales_person_id from orders"),
    ("sales_line", "select * from line where l_returnflag <> 'N'"),
    ("purchase_line", "select * from line where l_returnflag = 'N'"),
    ("purchase_order", "select order_id as id, min(vendor_id) as vendor_id, cast(min(l_shipdate) as date) as creation_date, cast(min(l_shipdate) + interval 14 day as date) as due_date, order_id % 25 as responsible_person_id, case when order_id % 11 = 0 then 'Draft' when order_id % 13 = 0 then 'Cancelled' when sum(done_qty) = 0 then 'Confirmed' when sum(done_qty) < sum(ordered_qty) then 'Partially Received' else 'Fully Received' end as status from purchase_line group by order_id"),
    ("bom_component", "select p.product_id as bom_id, c.product_id as component_product_id, cast(c.product_id % 5 + 1 as decimal(14,3)) as to_consume_qty from product p cross join (values (1), (2)) as k(step) join product c on c.product_id = p.product_id + k.step where p.bom_id is not null"),
    ("bom_operation", "select product_id as bom_id, op as operation_name, wc as work_center, cast(base + product_id % 10 as decimal(14,2)) as expected_duration from product cross join (values ('Cutting','Saw Line',45), ('Sanding','Belt Room',25), ('Crating','Dock C',15)) as o(op, wc, base) where bom_id is not null"),
    ("manufacturing_order", "select l_orderkey as id, min(l_partkey) as finished_product_id, min(l_partkey) as bom_id, cast(max(l_quantity) as decimal(14,3)) as quantity, cast(min(l_shipdate) as date) as schedule_date, l_orderkey % 25 as assignee_id, case l_orderkey % 5 when 0 then 'Draft' when 1 then 'Confirmed' when 2 then 'In Progress' when 3 then 'Done' else 'Cancelled' end as status from lineitem where l_partkey % 3 = 0 group by l_orderkey"),
    ("stock_movement", "select product_id, l_shipdate as movement_date, order_id, line_seq, case when l_returnflag = 'N' then 'PO' else 'SO' end as reference_type, case when l_returnflag = 'N' then done_qty else -done_qty end as movement_qty from line where done_qty > 0"),
    ("fulfil_command", "select user_id as line_id, event_id as seq, cast(value as decimal(14,3)) as requested_qty, cast(100 as decimal(14,3)) as ordered_qty from events where event_type in ('click', 'purchase')"),
    ("audit_log", "select event_id as id, ts as date_time, user_id, case cast(regexp_extract(props, '([0-9]+)', 1) as int) % 7 when 0 then 'Sales' when 1 then 'Purchase' when 2 then 'Manufacturing' when 3 then 'Product' when 4 then 'BoM' when 5 then 'Audit' else 'User' end as module, case when user_id % 2 = 0 then 'SalesOrder' else 'Product' end as record_type, concat('SO-', lpad(cast(user_id as string), 6, '0')) as record_id, case event_type when 'signup' then 'Created' when 'error' then 'Deleted' else 'Updated' end as action from events"),
    ("change_feed", "select user_id as record_id, event_id as seq, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as op, case when event_type <> 'view' then cast(value as decimal(14,3)) end as new_value, event_type as new_label from events"),
    ("app_user", "select n_nationkey as id, n_name as name, concat(lower(n_name), '@example.test') as email, case when n_nationkey = 0 then 'Admin' else 'User' end as role from nation"),
    ("permission", "select id as user_id, module, case when (id + ord) % 3 = 0 then 'Full' when (id + ord) % 3 = 1 then 'Limited' else 'None' end as can_view from app_user cross join (values ('Sales',0), ('Purchase',1), ('Manufacturing',2), ('Product',3), ('BoM',4), ('Audit',5), ('User',6)) as m(module, ord) where role <> 'Admin'"),
]


# Derived tables the oracle queries share: MO components instantiated from
# the BoM (C6), reservations over sales lines and MO components (D2) and the
# resulting stock position (D3).
DERIVED = [
    ("mo_component", "select mo.id as mo_id, bc.component_product_id as product_id, cast(bc.to_consume_qty * coalesce(nullif(mo.quantity, 0), 1) as decimal(20,3)) as to_consume_qty, cast(0 as decimal(20,3)) as consumed_qty from manufacturing_order mo join bom_component bc on bc.bom_id = mo.bom_id"),
    ("reserved_sales", "select l.product_id, cast(sum(greatest(l.ordered_qty - coalesce(l.done_qty, 0), 0)) as decimal(20,3)) as reserved_qty from sales_line l join sales_order o on o.id = l.order_id where o.status in ('Confirmed', 'Partially Delivered') group by l.product_id"),
    ("reserved_all", "select coalesce(a.product_id, b.product_id) as product_id, cast(coalesce(a.reserved_qty, 0) + coalesce(b.needed, 0) as decimal(20,3)) as reserved_qty from reserved_sales a full outer join (select product_id, sum(if(to_consume_qty > coalesce(consumed_qty, 0), to_consume_qty - coalesce(consumed_qty, 0), 0)) as needed from mo_component where mo_id in (select id from manufacturing_order where status = 'In Progress' or status = 'Confirmed') group by product_id) b on a.product_id = b.product_id"),
    ("position_sales", "select p.product_id, cast(p.on_hand_qty as decimal(20,3)) as on_hand_qty, cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty, cast(p.on_hand_qty - coalesce(r.reserved_qty, 0) as decimal(20,3)) as free_qty from product p left join reserved_sales r on r.product_id = p.product_id"),
    ("position_all", "select p.product_id, cast(p.on_hand_qty as decimal(20,3)) as on_hand_qty, cast(coalesce(r.reserved_qty, 0) as decimal(20,3)) as reserved_qty, cast(p.on_hand_qty - coalesce(r.reserved_qty, 0) as decimal(20,3)) as free_qty from product p left join reserved_all r on r.product_id = p.product_id"),
    ("receipt_command", "select user_id as line_id, event_id as seq, cast(value as decimal(14,3)) as requested_qty, cast(100 as decimal(14,3)) as ordered_qty from events where event_type in ('view', 'signup')"),
    ("consume_command", "select user_id as line_id, event_id as seq, cast(floor(value / 10) as decimal(14,3)) as requested_qty, cast(60 as decimal(14,3)) as need_qty from events where event_type = 'error'"),
    ("deliver_command", "select l.order_id, l.line_seq, l.ordered_qty as requested_qty, l.l_shipdate as cmd_time from sales_line l join sales_order o on o.id = l.order_id where o.status in ('Confirmed', 'Partially Delivered')"),
    ("receive_command", "select l.order_id, l.line_seq, cast(floor(l.ordered_qty / 10) * 10 as decimal(14,3)) as requested_qty, l.l_shipdate as cmd_time from purchase_line l join purchase_order o on o.id = l.order_id where o.status in ('Confirmed', 'Partially Received')"),
    ("sales_empty_request", "select id as order_id, cast(due_date as timestamp) as cmd_time from sales_order where id % 7 = 0"),
    ("purchase_empty_request", "select id as order_id, cast(due_date as timestamp) as cmd_time from purchase_order where id % 7 = 0"),
    ("sales_order_view", "select o.*, concat('SO-', lpad(cast(o.id + 1 as string), 6, '0')) as reference, c.c_name as customer_name from sales_order o left join customer c on c.c_custkey = o.o_custkey"),
    ("status_command", "select user_id as order_id, event_id as seq, case when event_type in ('view', 'signup') then 'confirm' when event_type = 'click' then 'start' when event_type = 'purchase' then 'produce' else 'cancel' end as command from events"),
    ("saved_user", "select cast(n_nationkey as bigint) as pos, n_nationkey as id, n_name as name, upper(concat(lower(n_name), '@example.test')) as email, 'Manager' as role from nation where n_regionkey = 1 union all select cast(r_regionkey + 100 as bigint), r_regionkey + 100, r_name, concat(lower(r_name), '@example.test'), 'User' from region"),
    ("produce_explicit", "select c.mo_id, c.product_id, c.mo_id * 10 as seq, cast(floor(c.to_consume_qty / 2) as decimal(14,3)) as requested_qty from mo_component c where c.mo_id in (select id from manufacturing_order where status = 'In Progress')"),
    ("produce_request", "select id as mo_id, id * 10 as seq, false as all_components from manufacturing_order where status = 'In Progress' union all select id, id * 10 + 1, true from manufacturing_order where status in ('Confirmed', 'In Progress')"),
    ("bom", "select bom_id as id, concat('BOM-', lpad(cast(bom_id as string), 6, '0')) as reference, product_id as finished_product_id, cast(1 as decimal(14,3)) as quantity from product where bom_id is not null"),
]


def with_views(sql: str) -> str:
    """Prefix a query with the tier-3 views and derived tables, as CTEs."""
    ctes = ",\n".join(f"{name} as ({body})" for name, body in VIEWS + DERIVED)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
