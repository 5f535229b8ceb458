"""The invented seed rows and the answers worked out by hand."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from stockflow.operators import audit, boards, bom, fulfil, lines, stock, summaries
from stockflow.sources.seed import SEED_DATE


def as_map(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def mo_components(seed):
    return bom.instantiate_components(seed["manufacturing_orders"], seed["bom_components"])


def test_reserved_sales_and_mo_scope(seed):
    s = seed
    r_sales = as_map(stock.reserved_sales(s["sales_orders"], s["sales_lines"], s["products"]), "product_id", "reserved_qty")
    assert r_sales == {1: D(3), 2: D(8), **{i: D(0) for i in range(3, 8)}}
    r_all = as_map(stock.reserved_all(s["sales_orders"], s["sales_lines"], s["manufacturing_orders"],
                                      mo_components(s), s["products"]), "product_id", "reserved_qty")
    assert r_all == {1: 3, 2: 8, 3: 0, 4: 18, 5: 18, 6: 80, 7: 0}


def test_free_to_use(seed):
    s = seed
    r = stock.reserved_all(s["sales_orders"], s["sales_lines"], s["manufacturing_orders"], mo_components(s))
    free = as_map(stock.stock_position(s["products"], r), "product_id", "free_qty")
    assert [free[i] for i in range(1, 8)] == [4, 6, 3, 42, 27, 820, 0]


def test_apply_reserved_keeps_unmatched(seed):
    s = seed
    base = s["products"].withColumn("reserved_qty", F.lit(D("7.000")))
    r = stock.reserved_sales(s["sales_orders"], s["sales_lines"])
    out = as_map(stock.apply_reserved(base, r), "product_id", "reserved_qty")
    assert out[1] == 3 and out[2] == 8 and out[5] == 7


def test_line_totals_both_rules(seed):
    s = seed
    so = as_map(lines.order_totals(s["sales_lines"], "unit_price", "view"), "order_id", "order_total")
    assert so == {1: D("1155.00"), 2: D("45.00"), 3: D("12.00")}
    po = as_map(lines.order_totals(s["purchase_lines"], "unit_price", "view"), "order_id", "order_total")
    assert po == {1: D("725.00"), 2: D("110.00")}
    so_b = as_map(lines.order_totals(s["sales_lines"], "unit_price", "booked"), "order_id", "order_total")
    po_b = as_map(lines.order_totals(s["purchase_lines"], "unit_price", "booked"), "order_id", "order_total")
    assert so_b[2] == D("180.00") and po_b[2] == D("245.00")


def test_availability(seed):
    s = seed
    r = stock.reserved_all(s["sales_orders"], s["sales_lines"], s["manufacturing_orders"], mo_components(s))
    pos = stock.stock_position(s["products"], r)
    sl = stock.line_availability(s["sales_lines"], pos, mode="sales")
    mc = stock.line_availability(mo_components(s), pos, need="to_consume_qty", mode="mo")
    assert {(r.order_id, r.line_seq): r.availability for r in sl.collect()} == {
        (1, 1): "Available", (1, 2): "Available", (2, 1): "Available", (3, 1): "Shortage"}
    assert {r.availability for r in mc.collect()} == {"Available"}


def test_dashboard_at_seed_date(seed):
    s = seed
    b = boards.status_board(s["sales_orders"], boards.BOARD_STATUSES["sales"], "sales_person_id", 2,
                            str(SEED_DATE), kind="sales")
    rows = {r.status: (r.all_count, r.my_count, r.late_count) for r in b.collect()}
    assert rows == {"Draft": (1, 1, 0), "Confirmed": (1, 1, 0), "Partially Delivered": (1, 1, 1),
                    "Fully Delivered": (0, 0, 0)}
    p = boards.status_board(s["purchase_orders"], boards.BOARD_STATUSES["purchase"], "responsible_person_id", 2,
                            str(SEED_DATE))
    rows = {r.status: (r.all_count, r.my_count, r.late_count) for r in p.collect()}
    assert rows["Confirmed"] == (1, 0, 0) and rows["Partially Received"] == (1, 0, 1)
    m = boards.status_board(s["manufacturing_orders"], boards.BOARD_STATUSES["manufacturing"], "assignee_id", 4,
                            str(SEED_DATE), due_col=None)
    assert {r.status: r.late_count for r in m.collect()} == {"Draft": 0, "Confirmed": 0, "In Progress": 0, "Done": 0}


def test_audit_counts(seed):
    c = audit.audit_counts(seed["audit_logs"]).first()
    assert (c.total, c.created, c.updated, c.deleted) == (6, 2, 2, 1)


def test_bom_instantiation_and_scaled_durations(seed):
    s = seed
    comps = {(r.mo_id, r.product_id): r.to_consume_qty for r in mo_components(s).collect()}
    assert comps == {(1, 4): 12, (1, 6): 32, (2, 4): 6, (2, 5): 18, (2, 6): 48}
    ops = bom.instantiate_operations(s["manufacturing_orders"], s["bom_operations"], scale_duration=True)
    d = sorted((r.mo_id, float(r.expected_duration)) for r in ops.collect())
    assert [x for _, x in d if _ == 1] == [50.0, 80.0]
    assert sorted(x for m, x in d if m == 2) == [90.0, 120.0, 210.0]
    unscaled = bom.instantiate_operations(s["manufacturing_orders"], s["bom_operations"])
    assert sorted(float(r.expected_duration) for r in unscaled.filter("mo_id = 1").collect()) == [25.0, 40.0]


def test_nested_bom_summary_no_fan_out(seed):
    s = seed
    doc = summaries.bom_summary(s["boms"], s["bom_components"], s["bom_operations"], s["products"], flat=False)
    r = {x.id: (len(x.components), len(x.operations)) for x in doc.collect()}
    assert r == {1: (2, 2), 2: (3, 3)}


def test_nested_sales_summary_and_completion(seed):
    s = seed
    r = stock.reserved_all(s["sales_orders"], s["sales_lines"], s["manufacturing_orders"], mo_components(s))
    pos = stock.stock_position(s["products"], r)
    doc = summaries.sales_order_summary(s["sales_orders"], s["sales_lines"], s["products"], s["users"], pos, flat=False)
    got = {x.id: (x.sales_person_name, [l.total for l in x.lines]) for x in doc.collect()}
    assert got == {1: ("Rosa Field", [D("225.00"), D("930.00")]), 2: ("Rosa Field", [D("45.00")]), 3: ("Rosa Field", [D("12.00")])}
    st = as_map(fulfil.completion_status(s["purchase_orders"], s["purchase_lines"], "purchase"), "order_id", "status")
    assert st == {1: "Partially Received", 2: "Partially Received"}


def test_line_text_over_nested_lines(seed):
    from stockflow.operators.search import line_text
    s = seed
    r = stock.reserved_all(s["sales_orders"], s["sales_lines"], s["manufacturing_orders"], mo_components(s))
    pos = stock.stock_position(s["products"], r)
    doc = summaries.sales_order_summary(s["sales_orders"], s["sales_lines"], s["products"], s["users"], pos, flat=False)
    got = {x.id: x.t for x in doc.select("id", line_text("lines").alias("t")).collect()}
    assert got == {1: "Lamp 5.000 Available<br>Oak bench 3.000 Available", 2: "Lamp 4.000 Available", 3: "Oil can 2.000 Shortage"}


def test_summary_views_for_sql(spark, seed):
    from stockflow.plans.views import register_views
    s = seed
    t = {"products": s["products"], "sales_orders": s["sales_orders"], "sales_lines": s["sales_lines"],
         "purchase_orders": s["purchase_orders"], "purchase_lines": s["purchase_lines"],
         "manufacturing_orders": s["manufacturing_orders"], "bom_components": s["bom_components"],
         "bom_operations": s["bom_operations"], "boms": s["boms"], "users": s["users"]}
    names = register_views(spark, t, str(SEED_DATE), 2)
    assert "sales_order_summary" in names
    r = spark.sql("select id, size(lines) as n, aggregate(lines, cast(0 as decimal(20,2)), (a, l) -> "
                  "cast(a + l.total as decimal(20,2))) as total from sales_order_summary order by id").collect()
    assert [(x.id, x.n, x.total) for x in r] == [(1, 2, D("1155.00")), (2, 1, D("45.00")), (3, 1, D("12.00"))]
    free = spark.sql("select free_qty from stock_position where product_id = 6").first().free_qty
    assert free == 820
    mo = spark.sql("select id, size(components) as c, size(operations) as o from manufacturing_order_summary "
                   "order by id").collect()
    assert [(x.id, x.c, x.o) for x in mo] == [(1, 2, 2), (2, 3, 3)]


def test_collect_distinct_undoes_fan_out(spark, seed):
    s = seed
    fanned = s["bom_components"].join(s["bom_operations"], "bom_id")  # components x operations rows per BoM
    got = summaries.collect_distinct(fanned, "bom_id", ["component_product_id", "to_consume_qty"], "c").collect()
    assert {r.bom_id: len(r.c) for r in got} == {1: 2, 2: 3}
