"""Tables stored by a key (A1, A4): bucketed and sorted, so that tables of one
key and bucket count join, group and number by it without an exchange.

A folder holds Parquet files and a description (key, buckets, schema), so any
later session can open it; nothing stays in the catalog.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUCKET_BYTES = 256 << 20    # of input in one bucket
MAX_BUCKETS = 100_000       # Spark's own limit
_ABOUT = "_keyed.json"


def buckets_for(spark: SparkSession, input_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the largest of the tables that share a key: by its bytes,
    and enough that every core has one."""
    return min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-input_bytes // bucket_bytes)))


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path, _ABOUT)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_keyed(df: DataFrame, path: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Store ``df`` under ``path`` in ``buckets`` buckets of ``key``, each
    sorted by it, and open it. Rows of one bucket are written by one task; a
    key is never split, so a table in which one key holds a large share of the
    rows is better left unkeyed. ``dealt``: the rows already are in that many
    partitions of the key, and are not moved again."""
    spark = df.sparkSession
    name = f"keyed_{uuid.uuid4().hex}"
    ((df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")
    file, fs = _file(spark, path)
    out = fs.create(file, True)
    out.write(json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()}).encode())
    out.close()
    return read_keyed(spark, path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table stored under ``path``; Spark knows how it is stored."""
    file, fs = _file(spark, path)
    stream = fs.open(file)
    try:
        about = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    name = f"keyed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(about["schema"]))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{about['key']}`) SORTED BY (`{about['key']}`) "
              f"INTO {about['buckets']} BUCKETS LOCATION '{path}'")
    try:
        df = spark.table(name)
        df.schema  # resolved now; the name is not needed again
        return df
    finally:
        spark.sql(f"DROP TABLE {name}")
