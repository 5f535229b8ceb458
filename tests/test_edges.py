"""Tier 2: hand-written edge cases of the reference's behaviour."""

import math
from decimal import Decimal as D

from pyspark.sql import functions as F

from stockflow.operators import bom, changes, fulfil, search, summaries


def deliveries(spark, ordered, initial, requests, fallback=False):
    rows = [(1, i, float(r) if r is not None else None, float(ordered), float(initial) if initial is not None else None)
            for i, r in enumerate(requests)]
    df = spark.createDataFrame(rows, "line_id int, seq int, requested_qty double, ordered_qty double, done_qty double")
    a = fulfil.apply_quantity_commands(df, ["line_id"], ["seq"], fallback_to_need=fallback)
    return [float(r.delta) for r in a.orderBy("seq").collect()]


def test_deliver_more_than_ordered(spark):
    assert deliveries(spark, 5, 0, [9]) == [5.0]


def test_request_below_current(spark):
    assert deliveries(spark, 10, 4, [2]) == [0.0]


def test_repeated_and_rising(spark):
    assert [d for d in deliveries(spark, 10, 0, [3, 3, 7, 5, 12]) if d] == [3.0, 4.0, 3.0]


def test_initial_above_ordered(spark):
    assert deliveries(spark, 5, 8, [1, 5, 9]) == [0.0, 0.0, 0.0]


def test_nan_and_null_ignored(spark):
    assert deliveries(spark, 5, 0, [math.nan, None, 2]) == [0.0, 0.0, 2.0]


def test_consumption_zero_means_full_need(spark):
    assert deliveries(spark, 4, 0, [0], fallback=True) == [4.0]
    assert deliveries(spark, 4, 0, [None], fallback=True) == [4.0]


def test_produce_twice_adds_finished_twice(spark):
    mos = spark.createDataFrame([(1, 10, D(3))], "id long, finished_product_id long, quantity decimal(14,3)")
    cmds = spark.createDataFrame([(1, 1), (1, 2)], "mo_id long, seq long")
    assert [r.movement_qty for r in fulfil.finished_movements(cmds, mos).collect()] == [D(3), D(3)]


def test_order_without_lines_is_fully_delivered(spark):
    orders = spark.createDataFrame([(1,)], "id long")
    lines = spark.createDataFrame([], "order_id long, ordered_qty decimal(14,3), done_qty decimal(14,3)")
    assert fulfil.completion_status(orders, lines).first().status == "Fully Delivered"


def test_mo_quantity_zero_treated_as_one(spark):
    mos = spark.createDataFrame([(1, 7, D(0))], "id long, bom_id long, quantity decimal(14,3)")
    comps = spark.createDataFrame([(7, 5, D(4))], "bom_id long, component_product_id long, to_consume_qty decimal(14,3)")
    assert bom.instantiate_components(mos, comps).first().to_consume_qty == D(4)


def test_header_without_lines_gets_empty_array(spark):
    orders = spark.createDataFrame([(1, 2, "Draft")], "id long, sales_person_id long, status string")
    lines = spark.createDataFrame([], "order_id long, line_seq int, product_id long, ordered_qty decimal(14,3), done_qty decimal(14,3)")
    products = spark.createDataFrame([(1, "p", D(1), D(1))], "product_id long, product_name string, sales_price decimal(12,2), cost_price decimal(12,2)")
    users = spark.createDataFrame([(2, "u")], "id long, name string")
    pos = spark.createDataFrame([], "product_id long, on_hand_qty decimal(20,3), reserved_qty decimal(20,3)")
    doc = summaries.sales_order_summary(orders, lines, products, users, pos, flat=False).first()
    assert doc.lines == [] and doc.sales_person_name == "u"
    flat = summaries.sales_order_summary(orders, lines, products, users, pos, flat=True).collect()
    assert len(flat) == 1 and flat[0].line_seq is None


def test_search_empty_term_returns_all(spark):
    df = spark.createDataFrame([("A", None), ("b", "x")], "reference string, status string")
    assert search.search(df, "sales", "").count() == 2
    assert search.search(df, "sales", "B").count() == 1


def test_patch_explicit_null_overlay_vs_keep(spark):
    base = spark.createDataFrame([(1, "R1", "Units", D(5))], "id long, reference string, unit string, qty decimal(14,3)")
    patches = spark.createDataFrame([(1, 1, {"unit": None, "reference": "X", "qty": "0"})],
                                    "id long, seq long, patch map<string,string>")
    o = changes.overlay_patch(base, patches, "id").first()
    k = changes.keep_patch(base, patches, "id").first()
    assert (o.unit, o.reference, o.qty) == (None, "R1", D(0))
    assert (k.unit, k.reference, k.qty) == ("Units", "R1", D(5))


def test_reference_for_id_2(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    out = changes.assign_references(df, "SO", 0, ["k"], num_partitions=2).orderBy("k").collect()
    assert [r.reference for r in out] == ["SO-000001", "SO-000002", "SO-000003"]


def test_reference_code_keeps_seven_digits(spark):
    from stockflow.functions.scalars import reference_code
    r = spark.range(1).select(reference_code("SO", F.lit(1234567)).alias("r")).first().r
    assert r == "SO-1234567"


def test_actions_by_status(spark):
    df = spark.createDataFrame([(1, "Draft"), (2, "Confirmed"), (3, "Done")], "id long, status string")
    got = {r.id: r.actions for r in search.allowed_actions(df, "manufacturing").collect()}
    assert got == {1: ["Edit", "Logs", "Confirm", "Cancel"], 2: ["Edit", "Logs", "Start", "Produce", "Cancel"],
                   3: ["Edit", "Logs"]}


def test_user_document_non_array_yields_nothing(spark, tmp_path):
    from stockflow.sources.documents import read_user_document
    good = tmp_path / "good.json"
    good.write_text('{"users": [{"id": 1, "name": "A", "email": "a@example.test", "role": "User"}],'
                    ' "permissions": [{"user_id": 1, "module": "Sales", "can_view": "Full"}]}')
    bad = tmp_path / "bad.json"
    bad.write_text('{"users": {"id": 1}, "permissions": 3}')
    u, p = read_user_document(spark, str(good))
    assert u.count() == 1 and p.first().module == "Sales"
    u2, p2 = read_user_document(spark, str(bad))
    assert u2.count() == 0 and p2.count() == 0


def test_nested_form_holds_every_child_in_chunks(spark):
    from stockflow.operators.summaries import attach_children, collect_present
    df = spark.range(50).select(F.when(F.col("id") < 45, 1).otherwise(F.lit(None)).cast("int").alias("k"), F.col("id"))
    got = sorted(((r.k, r.chunk_no, [x.id for x in r.ids]) for r in collect_present(df, "k", ["id"], "ids", size=20).collect()), key=str)
    assert got == [(1, 0, list(range(20))), (1, 1, list(range(20, 40))), (1, 2, list(range(40, 45))), (None, 0, list(range(45, 50)))]
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    one = spark.createDataFrame([(1, i) for i in range(3)], "p int, x int")
    two = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 9)], "p int, y int")
    doc = attach_children(heads, "id", one, "p", "xs", ["x"], False, size=2)
    doc = attach_children(doc, "id", two, "p", "ys", ["y"], False, size=2)
    got = sorted((r.id, r.chunk_no, r.name, [v.x for v in r.xs], [v.y for v in r.ys]) for r in doc.collect())
    assert got == [(1, 0, "a", [0, 1], [0, 1]), (1, 1, "a", [2], [2, 3]), (1, 2, "a", [], [4, 5]), (1, 3, "a", [], [6]), (2, 0, "b", [], [9])]


def test_to_document_keeps_nulls(spark):
    from stockflow.functions.scalars import to_document
    df = spark.createDataFrame([(1, None)], "id int, unit string")
    assert df.select(to_document("id", "unit").alias("j")).first().j == '{"id":1,"unit":null}'
    assert df.select(to_document("id", "unit", keep_nulls=False).alias("j")).first().j == '{"id":1}'


def test_normalise_products_defaults(spark):
    from stockflow.operators.lines import normalise_products
    raw = spark.createDataFrame([(1, None, None, "", 0, None)],
                                "product_id long, on_hand_qty double, procure_on_demand boolean, "
                                "procurement_type string, vendor_id long, bom_id long")
    r = normalise_products(raw).first()
    assert (r.on_hand_qty, r.reserved_qty, r.free_to_use_qty, r.unit, r.procure_on_demand,
            r.procurement_type, r.vendor_id, r.bom_id) == (D(0), D(0), D(0), "Units", False, "", None, None)


def test_stream_resumes_without_double_counting(spark, tmp_path):
    """A restarted stream on the same checkpoint reads no file twice."""
    from stockflow.sources.model import Model, read_stream
    from stockflow.streaming import streams
    m = Model(spark, "/root/testdata/sf0.001")
    base = str(tmp_path / "s")
    net = streams.stream_net_movements(streams.movement_stream(read_stream(m, "lineitem")))
    p1 = streams.run_to_table(net, "n", spark, base=base)
    first = {r.product_id: r.net_qty for r in streams.latest(spark, p1, ["product_id"]).collect()}
    p2 = streams.run_to_table(net, "n", spark, base=base)
    again = {r.product_id: r.net_qty for r in streams.latest(spark, p2, ["product_id"]).collect()}
    assert first == again and len(first) > 0
    batch = {r.product_id: r.s for r in m.stock_movement.groupBy("product_id")
             .agg(F.sum("movement_qty").alias("s")).collect()}
    assert {k: float(v) for k, v in first.items()} == {k: float(v) for k, v in batch.items()}


def test_coerce_value_like_javascript_number(spark):
    from stockflow.functions.scalars import coerce_value
    vals = [("qty", "12"), ("qty", " 1e3 "), ("qty", ".5"), ("qty", "0x1F"), ("qty", "0b101"), ("qty", "0o17"),
            ("qty", "-Infinity"), ("qty", "12d"), ("qty", "-0x1F"), ("qty", ""), ("qty", "true"),
            ("due_date", "2024"), ("email", "5"), ("note", "abc")]
    df = spark.createDataFrame(vals, "k string, v string")
    got = [(r.c.kind, r.c.number, r.c.text, r.c.flag) for r in
           df.select(coerce_value("k", "v").alias("c")).collect()]
    assert got == [("number", 12.0, None, None), ("number", 1000.0, None, None), ("number", 0.5, None, None),
                   ("number", 31.0, None, None), ("number", 5.0, None, None), ("number", 15.0, None, None),
                   ("number", float("-inf"), None, None), ("text", None, "12d", None), ("text", None, "-0x1F", None),
                   ("null", None, None, None), ("boolean", None, None, True), ("text", None, "2024", None),
                   ("text", None, "5", None), ("text", None, "abc", None)]


def test_setops(spark):
    from stockflow.operators import setops
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert [r.id for r in setops.sort_by(setops.union_all(a, b)).collect()] == [3, 2, 2, 1]
    assert sorted((r.id, r.v) for r in setops.replace_rows(a, b, "id").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(r.v for r in setops.distinct_values(setops.append_rows(a, b), "v").collect()) == ["w", "x", "y", "z"]


def test_stream_dedupes_replayed_movements(spark, tmp_path):
    import datetime as dt
    from stockflow.streaming import streams
    src = tmp_path / "movements"
    schema = "movement_id long, product_id long, movement_qty decimal(14,3), ts timestamp"
    t0 = dt.datetime(2024, 1, 1)
    first = [(1, 7, D("-2.000"), t0), (2, 7, D("5.000"), t0), (3, 8, D("1.000"), t0)]
    replay = [(2, 7, D("5.000"), t0), (4, 8, D("3.000"), t0 + dt.timedelta(hours=1))]
    spark.createDataFrame(first, schema).write.parquet(str(src / "a"))
    spark.createDataFrame(replay, schema).write.parquet(str(src / "b"))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(str(src)))  # one file per micro-batch
    net = streams.stream_net_movements(stream, dedupe_key="movement_id", event_time="ts", retention="1 day")
    path = streams.run_to_table(net, "dedupe", spark, base=str(tmp_path / "out"))
    got = {r.product_id: r.net_qty for r in streams.latest(spark, path, ["product_id"]).collect()}
    assert got == {7: D("3.000"), 8: D("4.000")}


def test_fulfil_rejects_and_lines_after(spark):
    lines = spark.createDataFrame([(1, 1, 7, D(5), D(0)), (1, 2, 8, D(3), None)],
                                  "order_id long, line_seq long, product_id long, ordered_qty decimal(14,3), "
                                  "done_qty decimal(14,3)")
    cmds = spark.createDataFrame([(1, 1, D(2), 1), (1, 1, D(9), 2), (1, 9, D(1), 3)],
                                 "order_id long, line_seq long, requested_qty decimal(14,3), t int")
    out = fulfil.fulfil_sales(spark.createDataFrame([(1,)], "id long"), lines, cmds, ["t"])
    assert [(r.line_seq, r.t) for r in out["rejects"].collect()] == [(9, 3)]
    after = {r.line_seq: r.done_qty for r in out["lines"].collect()}
    assert after == {1: D(5), 2: None}
    assert [r.movement_qty for r in out["movements"].orderBy("t").collect()] == [D(-2), D(-3)]
    assert out["status"].first().status == "Partially Delivered"
    assert sorted(out.keys()) == ["audit", "lines", "movements", "rejects", "status"]


def test_produce_absent_list_quirk(spark):
    """Absent list: untouched components consumed in full, partly consumed
    ones not at all; produce twice adds finished goods twice."""
    mos = spark.createDataFrame([(1, 50, D(2))], "id long, finished_product_id long, quantity decimal(14,3)")
    comps = spark.createDataFrame([(1, 5, D(8), D(0)), (1, 6, D(4), D(0)), (1, 7, D(10), D(3))],
                                  "mo_id long, product_id long, to_consume_qty decimal(14,3), consumed_qty decimal(14,3)")
    explicit = spark.createDataFrame([(1, 6, 1, D(1))], "mo_id long, product_id long, seq long, requested_qty decimal(14,3)")
    produce = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)],
                                    "mo_id long, seq long, all_components boolean")
    out = fulfil.produce_orders(mos, comps, explicit, produce)
    cons = sorted((r.product_id, r.seq, r.movement_qty) for r in out["consumption"].collect())
    # product 5 untouched -> all 8 at the first list-less request (seq 2); product 6 got 1 at seq 1,
    # so the list-less request reads 1 and consumes nothing more; product 7 started at 3 -> nothing.
    assert cons == [(5, 2, D(-8)), (6, 1, D(-1))]
    assert sorted(r.seq for r in out["finished"].collect()) == [1, 2, 3]
    after = {r.product_id: r.consumed_qty for r in out["components"].collect()}
    assert after == {5: D(8), 6: D(1), 7: D(3)}
    assert out["status"].first().status == "Done"
