"""Hard negatives: rows of another label that score just below a positive.

Rows are dealt to shards by a first level of split points, and shards are cut
into blocks of bounded size by a hash (a vector that a third of the rows share
makes many blocks). Every shard keeps the range of distances of all its rows to
every split point; an anchor visits the blocks of the shards that the ranges do
not exclude (``gnat.excluded``). In a block's task a tree over its rows answers
the block's anchors, at most ``ANCHORS`` of them at once. Results are exact:
what a bounded sample of rows decides are the split points and the anchors'
first lower bounds, never which rows are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm import gnat
from stockflow.llm.codes import integers, usable
from stockflow.llm.common import store

SAMPLE = 2_048      # rows from which split points and first bounds are taken
SHARDS = 32         # split points of the first level
ROWS = 16_384       # rows of a block, about
ANCHORS = 8_192     # anchors that visit a block together, about


def _vectors(table: pa.Table | pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    column = table.column("vector")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    out = integers(flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, width), scale)
    if not gnat.exact(out.astype(np.float64)):
        raise ValueError("components too large for exact scores")
    return out.astype(np.float64)


def _ints(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy()


class Index:
    """Rows in shards and blocks, and what is known about them."""

    def __init__(self, rows: DataFrame, width: int, scale: int):
        """``rows``: id, label, vector, uid, stored."""
        self.width, self.scale = width, scale
        spread = Window.partitionBy(F.pmod("uid", F.lit(64))).orderBy("uid", "id")
        sample = (rows.withColumn("place", F.row_number().over(spread)).filter(F.col("place") <= SAMPLE)
                  .orderBy("uid", "id").limit(SAMPLE).drop("place").toArrow())
        self.sample, self.sample_label, self.sample_uid = _vectors(sample, width, scale), _ints(sample, "label"), _ints(sample, "uid")
        self.points = self.sample[gnat.far_points(self.sample, SHARDS)]
        self.rows = store(rows.mapInArrow(self._dealt(), rows.withColumn("shard", F.lit(0)).schema), "shards")
        self._measure()

    def _dealt(self):
        points, width, scale = self.points, self.width, self.scale

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard = gnat.squared(_vectors(b, width, scale), points).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], [*b.schema.names, "shard"])
        return deal

    def _measure(self) -> None:
        """Ranges of distances and norms of every shard, over all rows."""
        points, width, scale = self.points, self.width, self.scale

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, shard = _vectors(b, width, scale), _ints(b, "shard")
                apart, norm = gnat.squared(v, points), (v * v).sum(axis=1)
                for s in np.unique(shard):
                    here = shard == s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in ((int(s), pa.int32()), (int(here.sum()), pa.int64()),
                                                       (apart[here].min(axis=0).tolist(), pa.list_(pa.float64())),
                                                       (apart[here].max(axis=0).tolist(), pa.list_(pa.float64())),
                                                       (float(norm[here].min()), pa.float64()), (float(norm[here].max()), pa.float64()))],
                        ["shard", "n", "low", "high", "norm_low", "norm_high"])

        found = self.rows.select("vector", "shard").mapInArrow(
            measure, "shard int, n long, low array<double>, high array<double>, norm_low double, norm_high double")
        k = len(self.points)
        found = found.groupBy("shard").agg(
            F.sum("n").alias("n"), F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"),
            F.array(*[F.min(F.col("low")[i]) for i in range(k)]).alias("low"),
            F.array(*[F.max(F.col("high")[i]) for i in range(k)]).alias("high")).orderBy("shard").collect()  # SHARDS rows
        self.shards = [r["shard"] for r in found]
        self.low = np.sqrt(np.maximum(np.array([r["low"] for r in found]).reshape(-1, k).T, 0))
        self.high = np.sqrt(np.maximum(np.array([r["high"] for r in found]).reshape(-1, k).T, 0))
        self.norms = np.array([r["norm_low"] for r in found]), np.array([r["norm_high"] for r in found])
        self.cuts = [-(-r["n"] // ROWS) for r in found]
        self.first = np.cumsum([0, *self.cuts])[:-1].tolist()

    def blocks(self) -> Column:
        """A row's block."""
        shard = F.array(*[F.lit(self.shards.index(s) if s in self.shards else 0) for s in range(len(self.points))])[F.col("shard")]
        return (F.array(*map(F.lit, self.first))[shard] + F.pmod("uid", F.array(*map(F.lit, self.cuts))[shard]).cast("int")).cast("int")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(uid, anchor, place, id, score): for every window of every anchor,
        its ``k`` best rows in each block that it visits. ``anchors``: id,
        label, vector, uid and ``windows``, an array of (least, most)."""
        chunks = max(1, -(-anchors.count() // ANCHORS))
        visits = anchors.mapInArrow(self._visits(same, k), anchors.withColumn("block", F.lit(0)).schema).withColumn("chunk", F.pmod("uid", F.lit(chunks)))
        rows = (self.rows.withColumn("block", self.blocks()).select("id", "label", "vector", "uid", "block")
                .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long")))
        return rows.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(
            self._answers(same, k), "uid long, anchor long, place int, id long, score long")

    def _visits(self, same: bool, k: int):
        points, width, scale = self.points, self.width, self.scale
        low, high, norms = self.low, self.high, self.norms
        sample, sample_label, sample_uid = self.sample, self.sample_label, self.sample_uid
        spans = [np.arange(f, f + c) for f, c in zip(self.first, self.cuts)]

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, uid, label = _vectors(b, width, scale), _ints(b, "uid"), _ints(b, "label")
                who, least, most = _windows(b)
                # The k-th best of the sample bounds the k-th best of all rows.
                score = v @ sample.T
                fits = ((sample_label[None, :] == label[:, None]) == same) & (sample_uid[None, :] != uid[:, None])
                score = np.where(fits, score, -np.inf)[who]
                score[(score < least[:, None]) | (score > most[:, None])] = -np.inf
                if score.shape[1] >= k:
                    least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
                to_points = np.sqrt(np.maximum(gnat.squared(v, points), 0))[who]
                inner, outer = gnat.annulus((v * v).sum(axis=1)[who], least, most, *norms)
                stay = np.zeros((len(v), len(spans)), bool)
                for at in range(0, len(who), 256):
                    part = slice(at, at + 256)
                    np.logical_or.at(stay, who[part], ~gnat.excluded(to_points[part], low, high, inner[part], outer[part]))
                bounds = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.bincount(who, minlength=len(v)))), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(least), pa.array(most)], ["least", "most"]))
                columns = [bounds if n == "windows" else c for n, c in zip(b.schema.names, b.columns)]
                for i in range(len(v)):  # one anchor's blocks at a time
                    at = [spans[s] for s in np.flatnonzero(stay[i])]
                    if at:
                        block = np.concatenate(at)
                        yield pa.RecordBatch.from_arrays(
                            [*[c.take(pa.array(np.full(len(block), i))) for c in columns], pa.array(block, pa.int32())],
                            [*b.schema.names, "block"])
        return visits

    def _answers(self, same: bool, k: int):
        width, scale = self.width, self.scale
        names = ["uid", "anchor", "place", "id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def answers(rows: pa.Table, anchors: pa.Table) -> pa.Table:
            if not rows.num_rows or not anchors.num_rows:
                return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
            rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("uid", "ascending")], null_placement="at_end"))
            tree = gnat.Tree(_vectors(rows, width, scale), _ints(rows, "label"))
            places = {u: i for i, u in enumerate(_ints(rows, "uid").tolist())}
            uid = _ints(anchors, "uid")
            own = np.array([places.get(u, -1) for u in uid.tolist()])
            who, least, most = _windows(anchors)
            best = tree.search(_vectors(anchors, width, scale)[who], least, most, _ints(anchors, "label")[who], same, own[who], k)
            w, j = np.nonzero(best != gnat.NONE)
            score, place = tree.found(best[w, j])
            turn = np.arange(len(who)) - np.searchsorted(who, who)  # a window's place among its anchor's
            return pa.Table.from_arrays(
                [pa.array(uid[who][w]), anchors.column("id").combine_chunks().take(pa.array(who[w])), pa.array(turn[w], pa.int32()),
                 rows.column("id").combine_chunks().take(pa.array(place)), pa.array(score)], names)
        return answers


def _windows(anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, least and most score of every window, flattened."""
    column = anchors.column("windows")
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    who = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int))
    flat = lists.flatten()
    return who, flat.field("least").to_numpy(zero_copy_only=False), flat.field("most").to_numpy(zero_copy_only=False)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per anchor and window, numbered from 1 as ``rank``."""
    order = Window.partitionBy("uid", "anchor", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Scores are inner products of vectors of floor(scale * x).

    Anchors are the rows where ``anchor`` holds (a null: no). An anchor's
    positives are the ``positives`` other rows of its label that score
    highest; a positive's negatives are the ``negatives`` highest of the rows
    of other labels that score ``low`` to ``high`` percent of it. Ties go to
    the smaller id, null ids last.

    Rows with a null label, a null vector or a null or non-finite component
    take no part, nor do rows of another length than the longest vectors.
    Rows that repeat wholly count once; rows that share an id only are rows
    of their own. An empty table, or one without anchors, gives no rows.
    Components from 2**22 / sqrt(length) on, scaled, fail with an error: their
    scores would not be exact. Other columns of the input are not read.
    """
    tag = F.col(label) if isinstance(label, str) else label
    clean = (vectors.select(F.col(key).cast("long").alias("id"), tag.cast("long").alias("label"), F.col(vector).alias("vector"),
                            F.coalesce(anchor, F.lit(False)).alias("anchor"))
             .filter(usable(F.col("vector")) & F.col("label").isNotNull()).distinct()
             .withColumn("uid", F.xxhash64("id", "label", "vector")))
    clean = store(clean, "vectors")
    none = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = clean.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return none
    clean = clean.filter(F.size("vector") == width)
    index = Index(clean.drop("anchor"), width, scale)
    anchors = clean.filter("anchor").drop("anchor")

    every = F.array(F.struct(F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")))
    near = store(_best(index.search(anchors.withColumn("windows", every), True, positives), positives), "positives")
    windows = near.groupBy("uid", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))  # at most ``positives``
    asked = (anchors.join(windows, (anchors["uid"] == windows["uid"]) & anchors["id"].eqNullSafe(windows["anchor"]))
             .select(anchors["id"], "label", "vector", anchors["uid"], F.transform("near", lambda p: F.struct(
                 F.ceil(p["score"] * low / 100).cast("double").alias("least"),
                 F.floor(p["score"] * high / 100).cast("double").alias("most"))).alias("windows")))
    found = _best(index.search(store(asked, "windows"), False, negatives), negatives)
    positive = near.select(F.col("uid"), F.col("anchor"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.select("uid", "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positive, ["uid", "place"]).filter(found["anchor"].eqNullSafe(positive["anchor"]))
            .select(found["anchor"].alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
