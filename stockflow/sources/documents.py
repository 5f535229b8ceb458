"""JSON documents and snapshots.

The user document holds two arrays ({"users": [...], "permissions": [...]}).
Reading it is a single multi-line JSON file, so it is only for the small
user store; bulk exports use JSON lines (one record per line), written in
parallel by every task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("position", T.StringType()), T.StructField("mobile_number", T.StringType()),
    T.StructField("address", T.StringType()),
])
PERMISSION = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("module", T.StringType()),
    T.StructField("can_view", T.StringType()), T.StructField("can_create", T.StringType()),
    T.StructField("can_edit", T.StringType()), T.StructField("can_delete", T.StringType()),
])


def read_user_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A3: users and permissions from one JSON document. A value that is not
    an array yields no rows (explicit schema: a mismatched type reads as
    null, and explode of null gives nothing)."""
    doc_schema = T.StructType([T.StructField("users", T.ArrayType(USER)),
                               T.StructField("permissions", T.ArrayType(PERMISSION))])
    doc = spark.read.schema(doc_schema).option("multiLine", "true").json(path)
    users = doc.select(F.explode("users").alias("u")).select("u.*")
    perms = doc.select(F.explode("permissions").alias("p")).select("p.*")
    return users, perms


_CURRENT = "_CURRENT"


def _path(spark: SparkSession, *parts: str):
    p = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path, _CURRENT)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_snapshot(users: DataFrame, permissions: DataFrame, path: str) -> None:
    """A4: full replacement of the stored users and permissions (JSON lines,
    credentials never included: users go through the public allow-list).

    Both are written as a new version, which one small file then names: a
    reader sees the old users and permissions or the new ones, never a mix, and
    a crash before that file leaves the old version in place. The version
    before the new one is kept for readers that hold it; older ones go."""
    from stockflow.operators.access import public_users
    spark = users.sparkSession
    before = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    public_users(users).write.json(f"{path}/{version}/users")
    permissions.write.json(f"{path}/{version}/permissions")
    p, fs = _path(spark, path, _CURRENT)
    out = fs.create(p, True)
    out.write(version.encode())
    out.close()
    for s in fs.listStatus(_path(spark, path)[0]):
        if s.getPath().getName().startswith("v-") and s.getPath().getName() not in (version, before):
            fs.delete(s.getPath(), True)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1 for the snapshot written by write_snapshot."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no snapshot under {path}")
    return (spark.read.schema(USER).json(f"{path}/{version}/users"),
            spark.read.schema(PERMISSION).json(f"{path}/{version}/permissions"))


def write_summary_json(df: DataFrame, path: str) -> None:
    """A5: nested documents as JSON lines; null fields are written as null
    (Spark drops them by default)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def reference_bundle(products: DataFrame, position: DataFrame, vendors: DataFrame,
                     boms: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """One consistent set of lookups: products with their current
    reserved and free quantities (D1/D3 first), vendors, BoMs, public users."""
    from stockflow.operators.access import public_users
    prod = products.join(position.select("product_id", "reserved_qty", "free_qty"), "product_id", "left")
    return {"products": prod, "vendors": vendors, "boms": boms, "users": public_users(users)}
