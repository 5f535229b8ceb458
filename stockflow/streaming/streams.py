"""Streaming on-hand balance (I1) and audit counts.

Both are stateful aggregations with one state row per product (I1) or a
single row (I2), so no watermark is needed. Output goes through
``foreachBatch`` in complete mode: each micro-batch writes the whole result
as a new version, numbered by the batch, and drops versions before the last
two. Readers take the newest finished version, so what they read is as large
as the result, however many batches there were. The stream's own checkpoint
lives next to it, so a restarted query resumes from the last committed batch;
a replayed batch overwrites its own version.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact_sum
from stockflow.session import checkpoint_dir
from stockflow.types import QTY_SUM


def movement_stream(lineitem_stream: DataFrame) -> DataFrame:
    """Stock movements from a lineitem feed (same rule as the batch view,
    without the per-order line number, which needs a window)."""
    done = (F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
             .when(F.col("l_returnflag") == "A", F.floor(F.col("l_quantity") / 2).cast("double"))
             .otherwise(F.lit(0.0))).cast("decimal(14,3)")
    return (lineitem_stream.select(F.col("l_partkey").alias("product_id"), "l_returnflag", done.alias("done"))
            .filter(F.col("done") > 0)
            .select("product_id", F.when(F.col("l_returnflag") == "N", F.col("done"))
                    .otherwise(-F.col("done")).alias("movement_qty")))


def stream_net_movements(movements: DataFrame, dedupe_key: str | None = None,
                         event_time: str | None = None, retention: str = "7 days") -> DataFrame:
    """I1, streaming part: net movement per product so far. No join inside
    the stream: the state is one row per product and each micro-batch only
    reads its new files.

    With ``dedupe_key`` (a movement id) and ``event_time``, a movement that
    arrives again within ``retention`` of the watermark is counted once
    (replayed deliveries). The dedupe state is bounded by the retention.
    Replays older than that are not caught, so the source must not replay
    beyond it."""
    if dedupe_key:
        if not event_time:
            raise ValueError("dedupe needs an event_time column for the watermark")
        movements = movements.withWatermark(event_time, retention).dropDuplicatesWithinWatermark([dedupe_key])
    return (movements.groupBy("product_id")
            .agg(exact_sum("movement_qty", 3, QTY_SUM).alias("net_qty")))


def on_hand_from_net(net: DataFrame, opening: DataFrame) -> DataFrame:
    """I1, read side: on hand = opening + net movements, for the products
    that have movements (the others are in the batch stock position)."""
    o = opening.select("product_id", F.col("on_hand_qty").alias("_open"))
    return (net.join(o, "product_id", "left")
            .select("product_id", (F.coalesce("_open", F.lit(0)) + F.col("net_qty")).cast(QTY_SUM).alias("on_hand_qty")))


def stream_audit_counts(logs: DataFrame) -> DataFrame:
    """Running total / created / updated / deleted over the log feed."""
    a = F.col("action")
    return logs.groupBy().agg(F.count("*").alias("total"), F.count_if(a == "Created").alias("created"),
                              F.count_if(a == "Updated").alias("updated"),
                              F.count_if(a == "Deleted").alias("deleted"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions under ``path``, ascending."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def run_to_table(agg: DataFrame, name: str, spark: SparkSession, base: str | None = None) -> str:
    """Run a streaming aggregate over everything available now; return the
    folder of the versioned output table."""
    base = base or os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out, ckpt = os.path.join(base, "table"), os.path.join(base, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        session = batch.sparkSession
        for old in _versions(session, out)[:-2]:  # a reader may still hold the last but one
            p = session._jvm.org.apache.hadoop.fs.Path(f"{out}/v={old}")
            p.getFileSystem(session._jsc.hadoopConfiguration()).delete(p, True)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of an output table, one row per key."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")
