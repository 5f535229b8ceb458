"""A2: literal seed rows as DataFrames, the small fixture of the tests.

An invented workshop: two built products, their parts, and a few orders in
different states. Nothing in it is taken from elsewhere.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import DataFrame, SparkSession

SEED_DATE = dt.date(2025, 3, 10)


def seed_rows(spark: SparkSession) -> dict[str, DataFrame]:
    def day(n: int) -> dt.date:
        return SEED_DATE + dt.timedelta(days=n)

    def table(schema: str, rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, schema.replace("QTY", "decimal(14,3)").replace("MONEY", "decimal(12,2)"))

    products = table(
        "product_id long, reference string, product_name string, sales_price MONEY, cost_price MONEY, "
        "on_hand_qty QTY, procure_on_demand boolean, procurement_type string, vendor_id long, bom_id long",
        [(1, "PROD-000001", "Oak bench", D("310.00"), D("190.00"), D(7), True, "Manufacturing", None, 1),
         (2, "PROD-000002", "Lamp", D("45.00"), D("20.00"), D(14), False, None, None, None),
         (3, "PROD-000003", "Steel stool", D("80.00"), D("48.00"), D(3), True, "Manufacturing", None, 2),
         (4, "PROD-000004", "Oak plank", D("12.50"), D("7.25"), D(60), True, "Purchase", 1, None),
         (5, "PROD-000005", "Steel tube", D("9.00"), D("4.50"), D(45), True, "Purchase", 2, None),
         (6, "PROD-000006", "Screw", D("0.20"), D("0.05"), D(900), True, "Purchase", 2, None),
         (7, "PROD-000007", "Oil can", D("6.00"), D("3.00"), D(0), False, None, None, None)])
    boms = table(
        "id long, reference string, finished_product_id long, quantity QTY, reference_note string",
        [(1, "BOM-000001", 1, D(1), "bench"), (2, "BOM-000002", 3, D(1), "stool")])
    bom_components = table(
        "bom_id long, component_product_id long, to_consume_qty QTY",
        [(1, 4, D(6)), (1, 6, D(16)), (2, 4, D(1)), (2, 5, D(3)), (2, 6, D(8))])
    bom_operations = table(
        "bom_id long, operation_name string, work_center string, expected_duration decimal(14,2)",
        [(1, "Sawing", "Saw room", D(25)), (1, "Joining", "Bench 2", D(40)),
         (2, "Bending", "Press", D(15)), (2, "Welding", "Cell 4", D(35)), (2, "Coating", "Spray room", D(20))])
    sales_orders = table(
        "id long, reference string, customer_name string, creation_date date, due_date date, sales_person_id long, status string",
        [(1, "SO-000001", "Harbour Cafe", SEED_DATE, day(6), 2, "Confirmed"),
         (2, "SO-000002", "Hill School", day(-9), day(-3), 2, "Partially Delivered"),
         (3, "SO-000003", "Mill Street 4", SEED_DATE, day(1), 2, "Draft")])
    sales_lines = table(
        "order_id long, line_seq int, product_id long, ordered_qty QTY, done_qty QTY, unit_price MONEY",
        [(1, 1, 2, D(5), D(0), D("45.00")), (1, 2, 1, D(3), D(0), D("310.00")),
         (2, 1, 2, D(4), D(1), D("45.00")), (3, 1, 7, D(2), D(0), D("6.00"))])
    purchase_orders = table(
        "id long, reference string, vendor_id long, creation_date date, due_date date, responsible_person_id long, status string",
        [(1, "PO-000001", 1, SEED_DATE, day(4), 3, "Confirmed"),
         (2, "PO-000002", 2, day(-6), day(-2), 3, "Partially Received")])
    purchase_lines = table(
        "order_id long, line_seq int, product_id long, ordered_qty QTY, done_qty QTY, unit_price MONEY",
        [(1, 1, 4, D(100), D(0), D("7.25")), (2, 1, 5, D(50), D(20), D("4.50")), (2, 2, 6, D(400), D(0), D("0.05"))])
    manufacturing_orders = table(
        "id long, finished_product_id long, quantity QTY, bom_id long, schedule_date date, assignee_id long, status string",
        [(1, 1, D(2), 1, day(3), 4, "Confirmed"), (2, 3, D(6), 2, day(-1), 4, "In Progress")])
    users = table(
        "id long, name string, email string, role string",
        [(1, "Iris Vane", "iris@example.test", "Admin"), (2, "Rosa Field", "rosa@example.test", "User"),
         (3, "Piet Brook", "piet@example.test", "User"), (4, "Nora Stone", "nora@example.test", "User")])
    audit_logs = table(
        "id long, user_id long, module string, record_type string, record_id string, action string",
        [(1, 1, "Product", "Product", "PROD-000002", "Created"), (2, 2, "Sales", "SalesOrder", "SO-000003", "Created"),
         (3, 2, "Sales", "SalesOrder", "SO-000002", "Updated"), (4, 3, "Purchase", "PurchaseOrder", "PO-000002", "Updated"),
         (5, 1, "Product", "Product", "PROD-000009", "Deleted"), (6, 4, "Manufacturing", "ManufacturingOrder", "MO-000002", "Viewed")])
    return {"products": products, "boms": boms, "bom_components": bom_components,
            "bom_operations": bom_operations, "sales_orders": sales_orders, "sales_lines": sales_lines,
            "purchase_orders": purchase_orders, "purchase_lines": purchase_lines,
            "manufacturing_orders": manufacturing_orders, "users": users, "audit_logs": audit_logs}
