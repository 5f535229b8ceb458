"""Registry of named queries: name -> (Spark builder, DuckDB oracle SQL).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
whole test tables. Oracle SQL is written against the raw tables with the
tier-3 views as CTEs; None means no SQL equivalent (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stockflow.plans.views_sql import with_views
from stockflow.sources.model import Model


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}
_MODELS: dict[tuple[int, str], Model] = {}


def model(spark: SparkSession, sf_dir: str) -> Model:
    key = (id(spark), sf_dir)
    if key not in _MODELS:
        _MODELS[key] = Model(spark, sf_dir)
    return _MODELS[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(m: Model) -> DataFrame`` under ``name``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(model(spark, sf_dir))
        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None, fn.__doc__ or "")
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the query modules fills REGISTRY.
    from stockflow.plans import queries, queries_history  # noqa: F401
    return REGISTRY
