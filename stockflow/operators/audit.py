"""Audit log filter and counts (B4, D6), newest-first listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_audit(logs: DataFrame, module: str | None = None, record: str | None = None) -> DataFrame:
    """Module equals ``module`` or record_type equals it; record id
    contains ``record`` (case-sensitive). Empty / None = no filter. The
    equality predicates reach the parquet scan as pushed filters."""
    out = logs
    if module:
        out = out.filter((F.col("module") == module) | (F.col("record_type") == module))
    if record:
        out = out.filter(F.col("record_id").cast("string").contains(record))
    return out


def audit_counts(logs: DataFrame) -> DataFrame:
    """Total, created, updated, deleted; other actions count in total only."""
    a = F.col("action")
    return logs.agg(F.count("*").alias("total"), F.count_if(a == "Created").alias("created"),
                    F.count_if(a == "Updated").alias("updated"),
                    F.count_if(a == "Deleted").alias("deleted"))


def newest_first(df: DataFrame, col: str = "id") -> DataFrame:
    """List order, newest (highest id) first. A global sort is a
    range-partitioned shuffle; use only where the caller needs the order."""
    return df.orderBy(F.col(col).desc())
