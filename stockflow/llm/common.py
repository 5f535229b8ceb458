"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import checkpoint_dir

# Broadcast sides above this many rows are joined by a shuffle instead.
BROADCAST_ROWS = 500_000


# Rows that Python workers get at a time. Texts are long: the default of
# 10,000 would hold tens of MB of them, several times over, in each worker.
BATCH_ROWS = 1_000


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (for local runs; on a cluster ship it with ``--py-files``), and hand them
    rows in batches of ``BATCH_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def store(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``, so that columns added
    beside it meet no name of the input. ``select("row.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted
    here; meant for stored tables), else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def most_frequent(counts: DataFrame, rows: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` (a stored table) with the largest ``n``, at most
    ``rows`` of them: all above the count from which there are no more.

    A histogram of log counts gives that count. A sort with a limit would send
    ``rows`` rows of every partition to the driver."""
    size = F.floor(F.log(F.col(n).cast("double")) * 64).cast("long")
    left, least = rows, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # some 64 rows per e-fold
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    return counts.filter(F.lit(False) if least is None else size >= least)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often
    (or inside whichever lambda) the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same where all is ASCII, and
    much faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
             .otherwise(F.translate(text, upper, upper.lower())))


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of ``separators`` (a regex class); null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), "")


# Separators of blank-delimited words: \x20 and \x09-\x0D.
BLANK = r"[\x20\x09-\x0D]"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
