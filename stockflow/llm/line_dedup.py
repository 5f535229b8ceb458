"""Line dedup over levelled sorted runs of line hashes.

A run holds, for the documents of some batches, one row per line key: its
128-bit hash and the number of documents with it. Runs are bucketed and sorted
by the hash, all alike, so joins and merges of runs move no rows. A new batch
of documents is merge-anti-joined with the runs: keys that they have settled
(already in enough documents) need no further counting. The rest becomes a run
of level 0; whenever a level has ``fanout`` runs, they are merged into one run
of the next level.

Only DataFrame functions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import ascii_lower, let, small, store
from stockflow.session import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"   # \x20 and \x09-\x0D
RUN_ROW = 24                # bytes of a run's row
BUCKET_BYTES = 64 << 20     # of rows in a bucket of a run
MAX_BUCKETS = 100_000       # Spark's own limit


def line_keys(text: Column) -> Column:
    """Keys of the text's lines, in order: stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))


def line_hashes(text: Column) -> Column:
    """Array of (h1, h2, pos, first), sorted by hash, of the lines whose key is
    not empty; ``first``: no earlier line of the text has the same key."""
    hashed = F.filter(
        F.transform(line_keys(text), lambda key, pos: F.when(key != "", F.struct(
            F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), pos.alias("pos")))),
        lambda h: h.isNotNull())

    def marked(order: Column) -> Column:
        return F.transform(order, lambda h, i: F.struct(
            h["h1"].alias("h1"), h["h2"].alias("h2"), h["pos"].alias("pos"),
            F.when(i == 0, True).otherwise((F.get(order, i - 1)["h1"] != h["h1"]) | (F.get(order, i - 1)["h2"] != h["h2"])).alias("first")))

    return let(F.array_sort(hashed), marked)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for runs of about ``rows`` rows: by their bytes, and no fewer
    than the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(least, -(-rows * RUN_ROW // BUCKET_BYTES)))


class LineRuns:
    """The runs. ``add`` takes one batch of (h1, h2, n) rows, ``frequent``
    gives the keys found in ``least`` documents or more so far."""

    def __init__(self, spark: SparkSession, least: int, buckets: int, fanout: int = 2):
        self.spark, self.least, self.buckets, self.fanout = spark, least, buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as a run under the shared checkpoint folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # resolved here; the files stay when the name goes
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row per key. Two runs are bucketed alike, so nothing is moved.
        (An aggregate over their union would rely on the union to keep the
        buckets together, which it does not in all plans.)"""
        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            more = b.withColumnRenamed("n", "more").hint("merge")
            return a.join(more, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

        return reduce(merge, runs)

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key no run has in ``least`` documents."""
        for run in self.runs():
            batch = batch.join(run.filter(F.col("n") >= self.least).hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key is in no run at all."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Count ``batch`` (h1, h2, n: a document may send its keys in any
        number of rows as long as n adds up) and keep it as a run."""
        counted = batch.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self._push(0, self._run(self.unsettled(counted).repartition(self.buckets, "h1", "h2")))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:  # merged upwards
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._run(self._merged(full)))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in ``least`` documents or more."""
        if not self.levels:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(self.runs()).filter(F.col("n") >= self.least).select("h1", "h2")


def hashed_lines(docs: DataFrame, batches: int = 1) -> DataFrame:
    """(id, mark, batch, lines): the line hashes of every document, stored.
    ``mark`` is a hash of the text; with the id it names the document's lines,
    which are the same for rows that share both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return store(docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(batches)).cast("int").alias("batch"), line_hashes(text).alias("lines")), "lines")


def drop_lines(docs: DataFrame, hashed: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``lines`` (n_lines, n_dropped, text):
    the text without the lines whose key is in ``frequent``.

    Only positions of dropped lines are moved; they meet their documents on
    (doc_id, hash of the text).
    """
    lines = hashed.select("id", "mark", F.inline("lines"))
    gone = (lines.join(small(frequent), ["h1", "h2"], "left_semi")
            .groupBy("id", "mark").agg(F.collect_set("pos").alias("gone")))
    whole = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    met = rows.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(whole) == F.col("mark")), "left")
    n = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")

    def kept(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col("gone").isNull(), whole).otherwise(let(F.split(whole, "\n"), kept))
    dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return met.select("doc", F.struct(n.alias("n_lines"), dropped.alias("n_dropped"), text.alias("text")).alias("lines"))


def frequent_lines(hashed: DataFrame, least: int, batches: int, fanout: int = 2) -> DataFrame:
    """(h1, h2) of the line keys found in ``least`` documents or more; the
    documents pass through the runs in ``batches`` batches."""
    spark = hashed.sparkSession
    rows = hashed.agg(F.sum(F.size("lines"))).first()[0] or 0
    runs = LineRuns(spark, least, bucket_count(spark, rows // batches), fanout)
    firsts = hashed.select("batch", F.inline("lines")).filter("first")
    for b in range(batches):
        runs.add(firsts.filter(F.col("batch") == b).select("h1", "h2", F.lit(1).cast("long").alias("n")))
    return store(runs.frequent(), "frequent")


def line_dedup(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` (all columns, as the struct ``doc``) with the struct ``lines``
    (n_lines, n_dropped, text): whole texts without the lines whose key is
    found in ``least`` documents or more.

    A key is the line with \\x20 and \\x09-\\x0D stripped at both ends and A-Z
    lower-cased; lines with an empty key stay. Every row counts as a document,
    rows that share an id or are equal too. A null or empty text is one empty
    line, and a text without a line left is empty. Null ids are ids like
    others, texts may be of any length, and an empty table gives no rows.
    Input columns keep their names inside ``doc``, whatever they are called.
    """
    hashed = hashed_lines(docs, batches)
    return drop_lines(docs, hashed, frequent_lines(hashed, least, batches, fanout))


def digests(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return deduped.select("doc.doc_id", "lines.n_lines", "lines.n_dropped",
                          F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))
