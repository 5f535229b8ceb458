"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is created by the platform and already names a
shared ``spark.checkpoint.dir``; we only read it (and refuse to run without
it). Local runs (tests, bench) get a scratch folder under /tmp when nothing
is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for date arithmetic, AQE for runtime
# coalescing and skew-join splitting, ANSI semantics as in Spark 4.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stockflow") -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STOCKFLOW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    (local tests) a fresh scratch folder is created and registered. The
    SparkContext's checkpoint folder is registered once; later calls only
    read it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; the server owns checkpointing
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this session")
        return path
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = sc.getCheckpointDir()
        if current:  # set directly on the context by the caller
            return current
        if not sc.master.startswith("local"):
            # A machine-local folder would not survive executor loss on a cluster.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        path = tempfile.mkdtemp(prefix="stockflow-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def tune_for_input(spark: SparkSession, input_bytes: int, cores: int | None = None,
                   target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Size shuffles and file splits for an input volume (runtime SQL confs).

    The initial shuffle partition count is input / target (at least the
    core count, so every core has work); AQE then coalesces small partitions
    toward the advisory size and splits skewed ones. File splits match the
    target so each scan task reads about one target's worth of parquet.
    Broadcasts stay at AQE's measured-size threshold.
    """
    cores = cores or spark.sparkContext.defaultParallelism
    parts = max(cores, -(-input_bytes // target_partition_bytes))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
