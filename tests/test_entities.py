"""A1 + schema rules: entity tables stored with the fixed schemas, read back
with read_tables, renamed for the operators, and checked by the rules."""

import datetime as dt
from decimal import Decimal as D

from stockflow import schemas as R
from stockflow.operators import quality, stock
from stockflow.sources.entities import operator_views
from stockflow.sources.tables import read_tables

NOW = dt.datetime(2025, 1, 15, 9, 0)
DAY = dt.date(2025, 1, 15)


def rows(spark, name, data):
    return spark.createDataFrame(data, R.SCHEMAS[name])


def entity_tables(spark):
    on_hand = [12, 35, 10, 5, 120, 30, 2000, 9, 11]
    return {
        "users": rows(spark, "users", [(1, "Admin One", "admin@example.test", "", "", "", "Admin", NOW),
                                       (2, "Sales One", "sales@example.test", "", "", "", "User", NOW)]),
        "vendors": rows(spark, "vendors", [(1, "V1", "", ""), (2, "V2", "", "")]),
        "products": rows(spark, "products", [
            (i, f"PROD-{i:06d}", f"Product {i}", D(1), D(1), D(on_hand[i - 1]), D(0), False, None, None,
             None, None, "Units", NOW, NOW) for i in range(1, 10)]),
        "bills_of_material": rows(spark, "bills_of_material", [
            (1, "BOM-000001", 1, D(1), "Units", "WTBL", NOW, NOW), (2, "BOM-000002", 4, D(1), "Units", "DTBL", NOW, NOW)]),
        "sales_orders": rows(spark, "sales_orders", [
            (1, "SO-000001", "A", "x", DAY, DAY, 2, "Confirmed", NOW, NOW),
            (2, "SO-000002", "B", "y", DAY, DAY, 2, "Partially Delivered", NOW, NOW)]),
        "sales_order_lines": rows(spark, "sales_order_lines", [
            (1, 1, 1, D(2), D(0), "Units", D(8500)), (2, 2, 2, D(6), D(3), "Units", D(2400))]),
        "manufacturing_orders": rows(spark, "manufacturing_orders", [
            (1, "MO-000001", 1, D(5), 1, DAY, 2, None, "Confirmed", NOW, NOW),
            (2, "MO-000002", 4, D(2), 2, DAY, 2, None, "In Progress", NOW, NOW)]),
        "mo_components": rows(spark, "mo_components", [
            (1, 1, 5, D(20), D(0), "Units"), (2, 1, 6, D(5), D(0), "Units"), (3, 1, 7, D(60), D(0), "Units"),
            (4, 2, 5, D(8), D(0), "Units"), (5, 2, 6, D(4), D(0), "Units"), (6, 2, 7, D(40), D(0), "Units")]),
    }


def test_read_tables_roundtrip_and_reserved(spark, tmp_path):
    base = str(tmp_path / "entities")
    t = entity_tables(spark)
    for name, df in t.items():
        df.write.parquet(f"{base}/{name}")
    back = read_tables(spark, base, {n: R.SCHEMAS[n] for n in t})
    assert all(back[n].schema == R.SCHEMAS[n] for n in t)
    v = operator_views(back)
    r = stock.reserved_all(v["sales_orders"], v["sales_lines"], v["manufacturing_orders"], v["mo_components"],
                           v["products"])
    got = {x.product_id: x.reserved_qty for x in r.collect()}
    assert got == {1: 2, 2: 3, 3: 0, 4: 0, 5: 28, 6: 9, 7: 100, 8: 0, 9: 0}


def test_clean_entities_have_no_violations(spark):
    assert quality.entity_violations(entity_tables(spark)).count() == 0


def test_planted_violations_are_found(spark):
    t = entity_tables(spark)
    t["users"] = t["users"].unionByName(rows(spark, "users", [(3, " ", "SALES@example.test", "", "", "", "Boss", NOW),
                                                                (3, "Dup", "dup@example.test", "", "", "", "User", NOW)]))
    t["bills_of_material"] = t["bills_of_material"].unionByName(rows(spark, "bills_of_material", [
        (3, "BOM-000003", 99, D(1), "Units", "TOO-LONG-NOTE", NOW, NOW)]))
    t["sales_orders"] = t["sales_orders"].unionByName(rows(spark, "sales_orders", [
        (3, "SO-000003", None, "z", DAY, None, 2, "Shipped", NOW, NOW)]))
    got = {(r.rule, r.table_name) for r in quality.entity_violations(t).collect()}
    assert {("unique", "users"), ("length", "bills_of_material"), ("foreign_key", "bills_of_material"),
            ("domain", "users"), ("domain", "sales_orders"), ("not_null", "sales_orders"),
            ("required", "users")} <= got


def test_rules_and_cascades_of_all_entities_are_registered(spark):
    """A bad status, an orphan component and a null price in the given tables
    are reported; every cascading child table loses rows."""
    from stockflow.plans import entity_rules
    from stockflow.plans.catalog import load_all
    from stockflow.sources.model import Model

    m = Model(spark, "/root/testdata/sf0.001", materialize=False)
    m.sales_order = m.sales_order.replace("Draft", "Shipped", "status")
    m.manufacturing_order = m.manufacturing_order.replace("Done", "Finished", "status")
    assert m.bom_component.count() > 0  # of the whole product table
    m.product = m.product.filter("product_id <> 4").selectExpr("* except (sales_price)", "if(product_id = 5, null, sales_price) as sales_price")
    got = {(r.rule, r.table_name, r.detail.split("=")[0]) for r in quality.entity_violations(entity_rules.entities(m)).collect()}
    assert {("domain", "sales_orders", "status"), ("domain", "manufacturing_orders", "status"), ("foreign_key", "bom_components", "component_product_id"),
            ("foreign_key", "mo_components", "product_id"), ("not_null", "products", "sales_price")} <= got
    assert {"entity_violations", "cascade_delete_all"} <= set(load_all())
    m = Model(spark, "/root/testdata/sf0.001")
    tables = entity_rules.entities(m)
    left = {r.table_name: r["count"] for r in load_all()["cascade_delete_all"].build(spark, "/root/testdata/sf0.001").groupBy("table_name").count().collect()}
    assert set(left) == {t for t, _, _ in R.CASCADE} and all(0 < n < tables[t].count() for t, n in left.items())


def test_month_partitioned_facts_are_pruned(spark, tmp_path):
    from stockflow.sources.model import Model
    from stockflow.sources.tables import read_months, write_by_month
    m = Model(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "movements")
    write_by_month(m.stock_movement, path, "movement_date")
    df = read_months(spark, path, "1996-01", "1996-03")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    expect = m.stock_movement.filter("date_format(movement_date, 'yyyy-MM') between '1996-01' and '1996-03'").count()
    assert df.count() == expect > 0


def test_grouped_key_checks_find_every_break(spark):
    t = {"users": spark.createDataFrame([(1, "a@x"), (1, "b@x"), (2, "a@x"), (None, None), (None, None)], "id long, email string"),
         "sales_orders": spark.createDataFrame([(1, 1, "R"), (2, 9, "R"), (3, None, "S")], "id long, sales_person_id long, reference string"),
         "audit_logs": spark.createDataFrame([(5, 7), (6, 2)], "id long, user_id long")}
    got = sorted(tuple(r) for r in quality.entity_violations(t).collect() if r.rule in ("unique", "foreign_key"))
    assert got == [("foreign_key", "audit_logs", "5", "user_id=7"), ("foreign_key", "sales_orders", "2", "sales_person_id=9"),
                   ("unique", "sales_orders", "R", "count=2"), ("unique", "users", "1", "count=2"),
                   ("unique", "users", "NULL", "count=2"), ("unique", "users", "NULL", "count=2"), ("unique", "users", "a@x", "count=2")]
    skipped = quality.skipped_rules(t)
    assert ("not_null", "users", "name") in skipped and ("unique", "products", "id") in skipped
    assert ("foreign_key", "audit_logs", "user_id") not in skipped and ("foreign_key", "products", "id") in skipped


def test_references_are_told_apart_by_their_key_first(spark):
    """A sort compares the start of its first column: one table's name tells none of its rows apart."""
    import re

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = {t: spark.createDataFrame([(i,) for i in ids], "id long") for t, ids in (("vendors", [1, 2]), ("bills_of_material", [3, 4]))}
        tables["products"] = spark.createDataFrame([(7, 1, 3), (8, 3, 4), (9, None, 2), (None, 4, None)], "id long, vendor_id long, bom_id long")
        lost = quality.check_references(tables, [("products", "vendor_id", "vendors"), ("products", "bom_id", "bills_of_material")])
        assert re.search(r"SortMergeJoin \[to_key#\d+, to_table#\d+\]", lost._jdf.queryExecution().executedPlan().toString())
        assert sorted(tuple(r) for r in lost.collect()) == [("foreign_key", "products", "8", "vendor_id=3"), ("foreign_key", "products", "9", "bom_id=2"),
                                                            ("foreign_key", "products", "NULL", "vendor_id=4")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
