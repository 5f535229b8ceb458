"""Search, action menus and display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import contains_ci

# Searchable fields per list view; other views search reference.
SEARCH_FIELDS = {
    "products": ["reference", "product_name"],
    "boms": ["reference", "reference_note", "finished_product_name"],
    "sales": ["reference", "customer_name"],
    "purchase": ["reference", "vendor_name"],
    "manufacturing": ["reference", "finished_product_name"],
}


def search(df: DataFrame, view: str, term: str | None = None, status: str | None = None) -> DataFrame:
    """Any of the view's fields contains ``term`` (case-insensitive; a
    null or missing field never matches) AND status equals ``status``.
    Empty arguments do not filter."""
    out = df
    if term:
        fields = [c for c in SEARCH_FIELDS.get(view, ["reference"]) if c in df.columns]
        pred = F.lit(False)
        for c in fields:
            pred = pred | contains_ci(c, term)
        out = out.filter(pred)
    if status:
        out = out.filter(F.col("status") == status)
    return out


# The actions the client offers, the kinds of order that have
# them, and the statuses they are offered from (None: all). The one rule table
# behind the action menus (B9) and the check of transitions.
_KINDS = ("sales", "purchase", "manufacturing")
_FINISHED = ("Fully Delivered", "Fully Received", "Done", "Cancelled")
ORDER_STATUSES = {
    "sales": ("Draft", "Confirmed", "Partially Delivered", "Fully Delivered", "Cancelled"),
    "purchase": ("Draft", "Confirmed", "Partially Received", "Fully Received", "Cancelled"),
    "manufacturing": ("Draft", "Confirmed", "In Progress", "Done", "Cancelled"),
}
ACTION_RULES: list[tuple[str, tuple[str, ...], tuple[str, ...] | None]] = [
    ("Edit", _KINDS, None),
    ("Logs", _KINDS, None),
    ("Confirm", _KINDS, ("Draft",)),
    ("Deliver", ("sales",), ("Confirmed", "Partially Delivered")),
    ("Receive", ("purchase",), ("Confirmed", "Partially Received")),
    ("Start", ("manufacturing",), ("Confirmed",)),
    ("Produce", ("manufacturing",), ("Confirmed", "In Progress")),
    ("Cancel", _KINDS, tuple(s for k in _KINDS for s in ORDER_STATUSES[k] if s not in _FINISHED)),
]


def allowed_actions(orders: DataFrame, kind: str) -> DataFrame:
    """The actions the client offers per order, from its status. Built
    as an array expression (no join, stays in generated code)."""
    s = F.col("status")
    offered = []
    for action, kinds, statuses in ACTION_RULES:
        if kind in kinds:
            if action == "Cancel":  # any status but a finished one, unknown ones included
                holds = ~s.isin(*_FINISHED)
            else:
                holds = F.lit(True) if statuses is None else s.isin(*statuses)
            offered.append(F.when(F.coalesce(holds, F.lit(False)), F.lit(action)))
    return orders.withColumn("actions", F.filter(F.array(*offered), lambda x: x.isNotNull()))


def allowed_commands(kind: str) -> list[tuple[str, str]]:
    """(status, command) pairs that the client offers for a kind of order."""
    return [(status, action.lower()) for action, kinds, statuses in ACTION_RULES if kind in kinds and statuses
            for status in ORDER_STATUSES[kind] if status in statuses]


def procurement_label(products: DataFrame) -> DataFrame:
    """Procurement type when procured on demand, else 'MTS'."""
    return products.withColumn(
        "procurement_label",
        F.when(F.coalesce(F.col("procure_on_demand"), F.lit(False)),
               F.coalesce(F.col("procurement_type"), F.lit(""))).otherwise(F.lit("MTS")))


def array_text(arr: str | Column, parts, sep: str) -> Column:
    """Join per-element text pieces of an array column with ``sep``.

    ``parts(x)`` returns the Column text for one element; no grouping here,
    so it applies to arrays that already exist (nested summaries)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(a, parts), sep)


def line_text(lines_col: str = "lines") -> Column:
    """D16: "name qty badge" per line, lines separated by '<br>'."""
    return array_text(lines_col, lambda x: F.concat_ws(
        " ", F.coalesce(x["product_name"], F.lit("")),
        F.coalesce(x["ordered_qty"].cast("string"), F.lit("")),
        F.coalesce(x["availability"], F.lit(""))), "<br>")


def component_text(col: str = "components") -> Column:
    """D16: "name x qty" per BoM component, separated by ', '."""
    return array_text(col, lambda x: F.concat(F.coalesce(x["component_name"], F.lit("")), F.lit(" x "),
                                               x["to_consume_qty"].cast("string")), ", ")


def operation_text(col: str = "operations") -> Column:
    """D16: "name <minutes>m" per operation, separated by ', '."""
    return array_text(col, lambda x: F.concat(F.coalesce(x["operation_name"], F.lit("")), F.lit(" "),
                                               x["expected_duration"].cast("string"), F.lit("m")), ", ")
