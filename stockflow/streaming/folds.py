"""Streams as runs of mergeable summaries.

Each micro-batch writes a summary of its own rows, one row per key that it
touches, as a run numbered by the batch. Runs are merged in levels, ``fanout``
of one width into one, so a batch's work follows the keys it changes and a
reader merges a few runs. A replayed batch overwrites its own run: merging
takes only runs of batches before the one at work, which are committed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.scalars import exact
from stockflow.operators.changes import change_summary, merge_summaries, state_of
from stockflow.operators.resume import ledger_batch, opening_state

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Runs:
    """Runs under ``path``, in folders named by the first and last batch."""

    spark: SparkSession
    path: str
    merge: Merge
    fanout: int = 4

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def spans(self, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) batch of the finished runs that no wider run covers;
        ``before``: of runs that end before this batch."""
        folder, fs = self._fs()
        if not fs.exists(folder):
            return []
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = []
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if name.startswith("run-") and fs.exists(Path(s.getPath(), "_SUCCESS")):
                first, last = map(int, name[4:].split("-"))
                if before is None or last < before:
                    found.append((first, last))
        return sorted(a for a in found if not any(b != a and b[0] <= a[0] and a[1] <= b[1] for b in found))

    def _at(self, span: tuple[int, int]) -> str:
        return f"{self.path}/run-{span[0]}-{span[1]}"

    def write(self, rows: DataFrame, first: int, last: int) -> None:
        rows.write.mode("overwrite").parquet(self._at((first, last)))

    def read(self, before: int | None = None) -> DataFrame | None:
        """All runs as one row per key; None where there are none."""
        spans = self.spans(before)
        return self.merge(reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(s)) for s in spans])) if spans else None

    def fold(self, before: int) -> None:
        """Merge the newest ``fanout`` runs of one width while there are as many."""
        while True:
            spans = self.spans(before)
            width = [b - a for a, b in spans[-self.fanout:]]
            if len(width) < self.fanout or len(set(width)) > 1:
                break
            some = spans[-self.fanout:]
            self.write(self.merge(reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(s)) for s in some])), some[0][0], some[-1][1])
        _, fs = self._fs()
        keep = set(self.spans(before))
        for s in fs.listStatus(self._fs()[0]) if fs.exists(self._fs()[0]) else []:
            name = s.getPath().getName()
            if name.startswith("run-"):
                first, last = map(int, name[4:].split("-"))
                if last < before and (first, last) not in keep:
                    fs.delete(s.getPath(), True)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], base: str) -> None:
    """Run ``write`` over what the stream has now; a later call with the same
    ``base`` goes on from the last committed batch."""
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def _net(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id").agg(F.sum("net").alias("net"))


def fold_on_hand(movements: DataFrame, base: str) -> Runs:
    """Net movement per product, folded: a batch adds up its own movements
    and rewrites nothing else. ``on_hand`` reads it."""
    runs = Runs(movements.sparkSession, f"{base}/net", _net)

    def write(batch: DataFrame, number: int) -> None:
        runs.fold(number)
        runs.write(_net(batch.select("product_id", exact("movement_qty").alias("net"))), number, number)

    run_available(movements, write, base)
    return runs


def fold_changes(feed: DataFrame, base: str, key: str, keep_cols: Sequence[str] = (), overlay_cols: Sequence[str] = ()) -> Runs:
    """E7 as a stream: summaries of create / update / delete rows per record,
    which merge in any order and any number of times. Deletes are kept as
    tombstones. ``current_records`` reads it."""
    runs = Runs(feed.sparkSession, f"{base}/changes", lambda rows: merge_summaries(rows, key, keep_cols, overlay_cols))

    def write(batch: DataFrame, number: int) -> None:
        runs.fold(number)
        runs.write(change_summary(batch, key, keep_cols, overlay_cols), number, number)

    run_available(feed, write, base)
    return runs


def current_records(runs: Runs, key: str, keep_cols: Sequence[str] = (), overlay_cols: Sequence[str] = ()) -> DataFrame | None:
    """The records alive after all batches (see ``compact_changes``)."""
    merged = runs.read()
    return None if merged is None else state_of(merged, key, keep_cols, overlay_cols)


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("resulting_on_hand", "through"), "batch").alias("s")
    return rows.groupBy("product_id").agg(last, F.max("batch").alias("batch")).select("product_id", "s.*", "batch")


def fold_ledger(movements: DataFrame, opening: DataFrame, order: Sequence[str], base: str) -> Runs:
    """E1 as a stream: every movement with its running balance, from a feed
    that arrives in ``order``. A batch reads its own movements and the folded
    balances of the products it touches; its rows go to ``<base>/ledger``, and
    movements at or before the last one of their product, which came too late
    to be balanced, to ``<base>/late``, both by batch (``read_ledger``). A hot
    product is split like in the batch ledger; a keyed state operator would
    give all its rows to one task."""
    spark = movements.sparkSession
    runs = Runs(spark, f"{base}/balances", _newest)
    start = opening_state(opening, movements, order).withColumn("batch", F.lit(-1).cast("long"))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        runs.fold(number)
        known = runs.read(number)
        touched = batch.select(F.col("product_id").alias("_touched")).distinct()
        state = (start if known is None else start.unionByName(known)).join(touched, F.col("product_id").eqNullSafe(F.col("_touched")), "left_semi")
        done = ledger_batch(batch, _newest(state), order)
        done.rows.write.mode("overwrite").parquet(f"{base}/ledger/batch={number}")
        done.late.write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        runs.write(done.state.withColumn("batch", F.lit(number).cast("long")), number, number)
        batch.unpersist()

    run_available(movements, write, base)
    return runs


def read_ledger(spark: SparkSession, base: str, part: str = "ledger") -> DataFrame:
    """The ledger's rows (``part`` 'late': the late movements) of all batches,
    with their ``batch``."""
    return spark.read.parquet(f"{base}/{part}")
