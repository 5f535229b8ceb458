"""Sorts and set operations (F1-F6) under the inventory's names.

They are single DataFrame calls; the list exists so the inventory maps one
to one. ``newest_first`` / ``sort_by`` is a range-partitioned global sort;
use it only where the caller needs the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.operators.boards import distinct_values  # noqa: F401  (F3)
from stockflow.operators.changes import replace_children
from stockflow.operators.lines import append_rows, flatten  # noqa: F401  (F4, F6)


def sort_by(df: DataFrame, cols: Sequence[str] = ("id",), descending: bool = True) -> DataFrame:
    """list order (newest first by default)."""
    return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in cols])


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """bag union by column name."""
    return a.unionByName(b)


def replace_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """delete the rows of every key present in ``new`` and insert the
    new set (anti join + union)."""
    return replace_children(base, new, key)
