"""A1: scans with explicit schemas (no inference on big inputs)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events")


# Columns of the driver's tables, so that no footer is read to plan.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables with its fixed schema; projection and
    filters applied later are pushed into this scan by Catalyst."""
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               fmt: str = "parquet", **options) -> DataFrame:
    """Scan of one entity table in parquet, json or csv with a fixed schema."""
    reader = spark.read.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return reader.format(fmt).load(path)


def read_tables(spark: SparkSession, base_dir: str, schemas: dict[str, T.StructType],
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """A1: every entity table under ``base_dir/<name>`` with its schema."""
    return {name: read_table(spark, os.path.join(base_dir, name), schema, fmt)
            for name, schema in schemas.items()}


def write_by_month(df: DataFrame, path: str, date_col: str, mode: str = "overwrite") -> None:
    """Write a fact table (ledger, audit log, movements) partitioned by month
    of ``date_col``, so date-range reads skip whole folders.

    Rows are range-partitioned on (date, row hash) first: every task holds
    a contiguous slice of dates and writes files for one or two months, and
    a month - even a single hot day - is spread over as many tasks as its
    size needs (hashing all columns splits ties on the date)."""
    from pyspark.sql import functions as F
    (df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM"))
       .repartitionByRange(F.col(date_col), F.xxhash64(*[F.col(c) for c in df.columns]))
       .write.mode(mode).partitionBy("month").parquet(path))


def read_months(spark: SparkSession, path: str, start: str | None = None,
                end: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Read a month-partitioned fact table; a [start, end] 'yyyy-MM' range
    becomes a partition filter (pruned at planning, no file of other months
    is listed or read)."""
    from pyspark.sql import functions as F
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema.add("month", T.StringType()))
    df = reader.parquet(path)
    if start:
        df = df.filter(F.col("month") >= start)
    if end:
        df = df.filter(F.col("month") <= end)
    return df
