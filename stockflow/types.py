"""Output types, fixed so Spark and the SQL oracle agree on schemas."""

QTY = "decimal(14,3)"       # stored quantities
QTY_SUM = "decimal(20,3)"   # aggregated / derived quantities
MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(20,2)"
DURATION = "decimal(14,2)"
DURATION_SUM = "decimal(20,2)"

# Order statuses whose lines reserve stock, per document kind.
OPEN_SALES = ("Confirmed", "Partially Delivered")
OPEN_PURCHASE = ("Confirmed", "Partially Received")
OPEN_MO = ("Confirmed", "In Progress")
TERMINAL = ("Fully Delivered", "Fully Received", "Done", "Cancelled")
