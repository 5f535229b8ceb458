"""Status dashboards, totals, kanban columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.types import TERMINAL

# The status lists shown on the dashboard per order kind
# (Cancelled is deliberately not listed).
BOARD_STATUSES = {
    "sales": ["Draft", "Confirmed", "Partially Delivered", "Fully Delivered"],
    "purchase": ["Draft", "Confirmed", "Partially Received", "Fully Received"],
    "manufacturing": ["Draft", "Confirmed", "In Progress", "Done"],
}


def status_board(orders: DataFrame, statuses: Sequence[str], owner_col: str, user_id: int,
                 as_of: str, due_col: str | None = "due_date",
                 kind: str | None = None) -> DataFrame:
    """Per status of a fixed list: all, mine and late counts.

    Every listed status appears (zero rows kept). Late = due date present,
    before ``as_of`` and status not terminal. A null owner is never mine.
    ``due_col=None`` gives late 0 (the reference reads a due date that
    manufacturing orders do not have). One partial + final aggregate; the
    result has at most len(statuses) rows.
    """
    spark = orders.sparkSession
    st = spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "pos int, status string")
    mine = F.coalesce(F.col(owner_col).cast("bigint") == F.lit(user_id), F.lit(False))
    if due_col:
        late = (F.col(due_col).isNotNull() & (F.col(due_col) < F.to_date(F.lit(as_of)))
                & ~F.col("status").isin(*TERMINAL))
    else:
        late = F.lit(False)
    agg = (orders.filter(F.col("status").isin(*statuses)).groupBy("status")
           .agg(F.count("*").alias("all_count"), F.count_if(mine).alias("my_count"),
                F.count_if(late).alias("late_count")))
    out = st.join(agg, "status", "left").select(
        *([F.lit(kind).alias("kind")] if kind else []), "pos", "status",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("all_count", "my_count", "late_count")])
    return out


def dashboard(sales: DataFrame, purchase: DataFrame, mos: DataFrame, user_id: int,
              as_of: str) -> DataFrame:
    """D4 for the three order kinds, one frame with a ``kind`` column."""
    return (status_board(sales, BOARD_STATUSES["sales"], "sales_person_id", user_id, as_of, "due_date", "sales")
            .unionByName(status_board(purchase, BOARD_STATUSES["purchase"], "responsible_person_id",
                                      user_id, as_of, "due_date", "purchase"))
            .unionByName(status_board(mos, BOARD_STATUSES["manufacturing"], "assignee_id",
                                      user_id, as_of, None, "manufacturing")))


def board_totals(board: DataFrame, logs: DataFrame) -> DataFrame:
    """Sum of all_count per kind (Cancelled is not on the board, so not
    counted) plus the audit log total as kind 'logs'."""
    per_kind = board.groupBy("kind").agg(F.sum("all_count").cast("bigint").alias("total"))
    log_total = logs.agg(F.count("*").cast("bigint").alias("total")).select(F.lit("logs").alias("kind"), "total")
    return per_kind.unionByName(log_total)


def shown_of_total(df: DataFrame, predicate) -> DataFrame:
    """D17: 'n of m' after a filter, both counts in one aggregate pass."""
    return df.agg(F.count_if(predicate).alias("shown"), F.count("*").alias("total"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """distinct non-empty values of a column."""
    return df.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()


def _first_present(df: DataFrame, cols: Sequence[str], default: str):
    present = [F.when(F.col(c) != "", F.col(c)) for c in cols if c in df.columns]
    return F.coalesce(*present, F.lit(default))


# Card title and subtitle fields, first non-empty wins.
CARD_TITLE = ["reference", "product_name", "reference_note"]
CARD_SUBTITLE = ["customer_name", "vendor_name", "finished_product_name", "product_name"]


def kanban(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kanban columns (status, card_count) and cards (status, title,
    subtitle). Rows with an empty status are not shown. Cards stay rows; a
    column is not gathered into one array, so a hot status cannot overload
    a task."""
    shown = df.filter(F.col("status").isNotNull() & (F.col("status") != ""))
    columns = shown.groupBy("status").agg(F.count("*").alias("card_count"))
    cards = shown.select("status", _first_present(df, CARD_TITLE, "Unknown").alias("title"),
                         _first_present(df, CARD_SUBTITLE, "").alias("subtitle"))
    return columns, cards
