"""The 17 entity tables of the data model as fixed Spark schemas, and the
schema's integrity rules as data (driving quality.entity_violations).

Fixed values: table and column names, types and constraints of the
reference's relational schema. The users table carries no credential
column.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
D, TS = T.DateType(), T.TimestampType()
MONEY, QTY, DUR = T.DecimalType(12, 2), T.DecimalType(14, 3), T.DecimalType(14, 2)


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "reference_sequences": _s(("prefix", S), ("next_value", I)),
    "users": _s(("id", L), ("name", S), ("email", S), ("mobile_number", S), ("address", S),
                ("position", S), ("role", S), ("created_at", TS)),
    "user_module_permissions": _s(("id", L), ("user_id", L), ("module", S), ("can_view", S),
                                  ("can_create", S), ("can_edit", S), ("can_delete", S)),
    "vendors": _s(("id", L), ("vendor_name", S), ("vendor_address", S), ("contact_info", S)),
    "products": _s(("id", L), ("reference", S), ("product_name", S), ("sales_price", MONEY),
                   ("cost_price", MONEY), ("on_hand_qty", QTY), ("reserved_qty", QTY),
                   ("procure_on_demand", B), ("procurement_type", S), ("vendor_id", L), ("bom_id", L),
                   ("image_url", S), ("unit", S), ("created_at", TS), ("updated_at", TS)),
    "bills_of_material": _s(("id", L), ("reference", S), ("finished_product_id", L), ("quantity", QTY),
                            ("unit", S), ("reference_note", S), ("created_at", TS), ("updated_at", TS)),
    "bom_components": _s(("id", L), ("bom_id", L), ("component_product_id", L), ("to_consume_qty", QTY),
                         ("unit", S)),
    "bom_operations": _s(("id", L), ("bom_id", L), ("operation_name", S), ("work_center", S),
                         ("expected_duration", DUR)),
    "sales_orders": _s(("id", L), ("reference", S), ("customer_name", S), ("customer_address", S),
                       ("creation_date", D), ("due_date", D), ("sales_person_id", L), ("status", S),
                       ("created_at", TS), ("updated_at", TS)),
    "sales_order_lines": _s(("id", L), ("sales_order_id", L), ("product_id", L), ("ordered_qty", QTY),
                            ("delivered_qty", QTY), ("unit", S), ("sales_unit_price", MONEY)),
    "purchase_orders": _s(("id", L), ("reference", S), ("vendor_id", L), ("vendor_name", S),
                          ("vendor_address", S), ("creation_date", D), ("due_date", D),
                          ("responsible_person_id", L), ("source_note", S), ("status", S),
                          ("created_at", TS), ("updated_at", TS)),
    "purchase_order_lines": _s(("id", L), ("purchase_order_id", L), ("product_id", L), ("ordered_qty", QTY),
                               ("received_qty", QTY), ("unit", S), ("cost_price", MONEY)),
    "manufacturing_orders": _s(("id", L), ("reference", S), ("finished_product_id", L), ("quantity", QTY),
                               ("bom_id", L), ("schedule_date", D), ("assignee_id", L), ("source_note", S),
                               ("status", S), ("created_at", TS), ("updated_at", TS)),
    "mo_components": _s(("id", L), ("mo_id", L), ("product_id", L), ("to_consume_qty", QTY),
                        ("consumed_qty", QTY), ("unit", S)),
    "mo_work_orders": _s(("id", L), ("mo_id", L), ("operation_name", S), ("work_center", S),
                         ("expected_duration", DUR), ("real_duration", DUR), ("status", S)),
    "stock_ledger": _s(("id", L), ("product_id", L), ("movement_qty", QTY), ("reference_type", S),
                       ("reference_id", L), ("reference_number", S), ("movement_date", TS),
                       ("resulting_on_hand", QTY)),
    "audit_logs": _s(("id", L), ("date_time", TS), ("user_id", L), ("module", S), ("record_type", S),
                     ("record_id", S), ("action", S), ("field_changed", S), ("old_value", S),
                     ("new_value", S)),
}

# Integrity rules of the schema.
UNIQUE = {
    "reference_sequences": [["prefix"]], "users": [["id"], ["email"]],
    "user_module_permissions": [["id"], ["user_id", "module"]], "vendors": [["id"]],
    "products": [["id"], ["reference"]], "bills_of_material": [["id"], ["reference"]],
    "bom_components": [["id"]], "bom_operations": [["id"]], "sales_orders": [["id"], ["reference"]],
    "sales_order_lines": [["id"]], "purchase_orders": [["id"], ["reference"]],
    "purchase_order_lines": [["id"]], "manufacturing_orders": [["id"], ["reference"]],
    "mo_components": [["id"]], "mo_work_orders": [["id"]], "stock_ledger": [["id"]], "audit_logs": [["id"]],
}
FOREIGN_KEYS = [  # (child, column, parent); parent key is id
    ("user_module_permissions", "user_id", "users"), ("products", "vendor_id", "vendors"),
    ("products", "bom_id", "bills_of_material"), ("bills_of_material", "finished_product_id", "products"),
    ("bom_components", "bom_id", "bills_of_material"), ("bom_components", "component_product_id", "products"),
    ("bom_operations", "bom_id", "bills_of_material"), ("sales_orders", "sales_person_id", "users"),
    ("sales_order_lines", "sales_order_id", "sales_orders"), ("sales_order_lines", "product_id", "products"),
    ("purchase_orders", "vendor_id", "vendors"), ("purchase_orders", "responsible_person_id", "users"),
    ("purchase_order_lines", "purchase_order_id", "purchase_orders"),
    ("purchase_order_lines", "product_id", "products"),
    ("manufacturing_orders", "finished_product_id", "products"),
    ("manufacturing_orders", "bom_id", "bills_of_material"), ("manufacturing_orders", "assignee_id", "users"),
    ("mo_components", "mo_id", "manufacturing_orders"), ("mo_components", "product_id", "products"),
    ("mo_work_orders", "mo_id", "manufacturing_orders"), ("stock_ledger", "product_id", "products"),
    ("audit_logs", "user_id", "users"),
]
_LEVELS = ["Full", "Limited", "Optional", "None"]
DOMAINS = [
    ("users", "role", ["Admin", "User"]),
    ("user_module_permissions", "module", ["Sales", "Purchase", "Manufacturing", "Product", "BoM", "Audit", "User"]),
    ("user_module_permissions", "can_view", _LEVELS), ("user_module_permissions", "can_create", _LEVELS),
    ("user_module_permissions", "can_edit", _LEVELS), ("user_module_permissions", "can_delete", _LEVELS),
    ("products", "procurement_type", ["Purchase", "Manufacturing"]),
    ("sales_orders", "status", ["Draft", "Confirmed", "Partially Delivered", "Fully Delivered", "Cancelled"]),
    ("purchase_orders", "status", ["Draft", "Confirmed", "Partially Received", "Fully Received", "Cancelled"]),
    ("manufacturing_orders", "status", ["Draft", "Confirmed", "In Progress", "Done", "Cancelled"]),
    ("stock_ledger", "reference_type", ["SO", "PO", "MO"]),
    ("audit_logs", "action", ["Created", "Updated", "Deleted", "Status Changed"]),
]
NOT_NULL = {
    "reference_sequences": ["next_value"], "users": ["name", "email", "role"],
    "user_module_permissions": ["user_id", "module"], "vendors": ["vendor_name"],
    "products": ["reference", "product_name", "sales_price", "cost_price", "on_hand_qty", "reserved_qty",
                 "procure_on_demand", "unit"],
    "bills_of_material": ["reference", "finished_product_id", "quantity", "unit", "reference_note"],
    "bom_components": ["bom_id", "component_product_id", "to_consume_qty", "unit"],
    "bom_operations": ["bom_id", "operation_name", "work_center", "expected_duration"],
    "sales_orders": ["reference", "customer_name", "customer_address", "creation_date", "status"],
    "sales_order_lines": ["sales_order_id", "product_id", "ordered_qty", "delivered_qty", "unit",
                          "sales_unit_price"],
    "purchase_orders": ["reference", "vendor_name", "vendor_address", "creation_date", "status"],
    "purchase_order_lines": ["purchase_order_id", "product_id", "ordered_qty", "received_qty", "unit",
                             "cost_price"],
    "manufacturing_orders": ["reference", "finished_product_id", "quantity", "bom_id", "status"],
    "mo_components": ["mo_id", "product_id", "to_consume_qty", "consumed_qty", "unit"],
    "mo_work_orders": ["mo_id", "operation_name", "work_center", "expected_duration", "real_duration", "status"],
    "stock_ledger": ["product_id", "movement_qty", "reference_type", "reference_id", "reference_number",
                     "movement_date", "resulting_on_hand"],
    "audit_logs": ["date_time", "module", "record_type", "record_id", "action"],
}
LENGTH = [("bills_of_material", "reference_note", 8)]
REQUIRED = [("users", ["name", "email"])]
CASCADE = [  # (child, column, parent) deleted with the parent
    ("user_module_permissions", "user_id", "users"), ("bom_components", "bom_id", "bills_of_material"),
    ("bom_operations", "bom_id", "bills_of_material"), ("sales_order_lines", "sales_order_id", "sales_orders"),
    ("purchase_order_lines", "purchase_order_id", "purchase_orders"),
    ("mo_components", "mo_id", "manufacturing_orders"), ("mo_work_orders", "mo_id", "manufacturing_orders"),
]
