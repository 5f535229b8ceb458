"""Intermediate tables in the shared checkpoint folder.

Writing one ends a plan's lineage: it is computed once however often it is
read, and a lost executor costs a re-read. ``release`` deletes the tables of
this session once the results that read them are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockflow.session import checkpoint_dir

_PATHS: dict[str, list[str]] = {}


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{tag}")
    _PATHS.setdefault(_app(spark), []).append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{tag}")


def release(spark: SparkSession) -> int:
    """Delete the tables stored by this session; their number."""
    paths = _PATHS.pop(_app(spark), [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _app(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id")
