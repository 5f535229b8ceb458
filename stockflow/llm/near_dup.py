"""Near duplicates by SetSketch registers.

Each set gets registers: minima of exponentially distributed hashes,
truncated to powers of a base. Sketches of parts merge by a register-wise
maximum. Register values are cut into bands; sets that share a band are
candidates. A joint likelihood over two sketches drops far pairs, and the
rest is confirmed on the full sets.

Equal sets are one class from the start. Candidates are joined in stars, not
in pairs; a group of candidates is compared in blocks that emit a spanning
forest of confirmed links, so a group of thousands gives thousands of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import packed, small, store
from stockflow.llm.graph import connected_components
from stockflow.llm.hashing import WordHashes, mix, runs

SHINGLE = 5
BASE = 1.02            # step between register values
RATE = 20.0            # rate of the exponential hashes
TOP = 2_000            # largest register: sets beyond 10**15 would saturate
REGISTERS = 180
MISSED = 1e-6          # most that a pair at the limit may be missed with
# Pairs whose likeliest similarity lies this far below the limit are dropped:
# over five standard deviations of the estimate.
MARGIN = 0.15
BLOCK = 256            # sets on each side of a comparison block

_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 2 ** 64, REGISTERS, np.uint64)
_ODD = _rng.integers(0, 2 ** 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles after lower-casing
    A-Z; of the whole sequence where it is shorter; none without words."""
    cut = (text or "").encode().lower().split()
    if not cut:
        return np.empty(0, np.uint64)
    h = words.of(cut)
    return np.unique(runs(h, n) if len(h) >= n else runs(h, len(h)) ^ np.uint64(len(h)))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):  # block by block, in cache
        part = items[at:at + 256, None] ^ _XOR
        part *= _ODD
        np.minimum(least, part.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0 ** 64
    exponential = -np.log1p(-np.minimum(u, 1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_rows(percent: int) -> int:
    """Registers per band: the most with which a pair at ``percent`` shares no
    band with probability ``MISSED`` at most (6 at 85, 5 at 80)."""
    p = percent / 100
    return max([n for n in range(1, 13) if (1 - p ** n) ** (REGISTERS // n) <= MISSED], default=1)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers."""
    bands = REGISTERS // rows
    parts = regs[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.astype(np.int64)


def _slope(regs_a, regs_b, n_a, n_b, j: float) -> np.ndarray:
    """Derivative at similarity ``j`` of the joint log likelihood of the
    registers of one set against many. The likelihood is concave, so the
    likeliest similarity is at least ``j`` where it is not negative."""
    above = (regs_a > regs_b).sum(axis=1)
    below = (regs_a < regs_b).sum(axis=1)
    equal = REGISTERS - above - below
    step = (BASE - 1) / BASE
    share = n_a / (n_a + n_b)
    other = 1 - share
    # P(register of a above that of b) depends on what a has alone, and so on.
    x, y = np.maximum(share - other * j, 1e-9), np.maximum(other - share * j, 1e-9)
    log = np.log(BASE)
    p, q = -np.log1p(-x * step) / log, -np.log1p(-y * step) / log
    dp, dq = -other * step / (1 - x * step) / log, -share * step / (1 - y * step) / log
    return above * dp / p + below * dq / q + equal * (-dp - dq) / np.maximum(1 - p - q, 1e-9)


def _sketch(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            items = shingle_set(text, words)
            regs = registers(items) if len(items) else None
            out.append((doc_id, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(),
                        None if regs is None else regs.tobytes(), [] if regs is None else band_keys(regs, rows)))
        yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "same", "regs", "keys"])


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for pdf in batches:
        yield pdf.assign(items=[shingle_set(t, words).tobytes() for t in pdf["text"]]).drop(columns="text")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect what the pairs of one block connect.
    rows: (side, doc_id, n, regs, items); pairs within a side only where both
    sides are the same."""
    ids = np.array([r[1] for r in rows])
    sizes = np.array([r[2] for r in rows], float)
    regs = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
    side = np.array([r[0] for r in rows])
    pairs = []
    for i in range(len(rows)):
        with_ = np.arange(i + 1, len(rows)) if side[i] == 0 else np.flatnonzero(side == 2) if side[i] == 1 else ()
        if len(with_):
            with_ = with_[100 * np.minimum(sizes[i], sizes[with_]) >= percent * np.maximum(sizes[i], sizes[with_])]
            slope = _slope(regs[i], regs[with_], sizes[i], sizes[with_], percent / 100 - MARGIN)
            same = (regs[i] == regs[with_]).sum(axis=1)
            pairs += [(-int(s), i, int(k)) for s, k, d in zip(same, with_, slope, strict=True) if d >= 0]
    forest, out, sets = _Forest(), [], {}
    for _, i, k in sorted(pairs):  # likeliest first
        a, b = forest.root(i), forest.root(k)
        if a == b:
            continue
        for x in (i, k):
            if x not in sets:
                sets[x] = np.frombuffer(rows[x][4], np.uint64)
        common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
        if 100 * common >= percent * (len(sets[i]) + len(sets[k]) - common):
            forest.up[a] = b
            out.append((int(ids[i]), int(ids[k])))
    return out


def _compare(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block; a block is bounded, so it fits in memory."""
    held, at = [], None

    def done() -> pd.DataFrame:
        return pd.DataFrame(_links(held, percent) if len(held) > 1 else [], columns=["src", "dst"]).astype("int64")

    for pdf in batches:
        for row in pdf[["block", "side", "doc_id", "n_shingles", "regs", "items"]].itertuples(index=False, name=None):
            if row[0] != at:
                if len(held) > 1:
                    yield done()
                held, at = [], row[0]
            held.append(row[1:])
    if held:
        yield done()


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """Each member once per block it is compared in: columns block, side.

    A link needs sizes within ``percent`` of each other. So members of a group
    are put on levels, powers of percent / 100 apart, and compared within a
    level and with the next one; a level is cut into parts of about ``BLOCK``
    sets by a hash, and parts are compared two by two. side: 0 both sides the
    same, 1 and 2 the two sides.
    """
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int")
    members = members.withColumn("level", level)
    cells = store(members.groupBy("grp", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "cells")
    near = [cells.select(F.col("grp").alias(f"g{k}"), (F.col("level") - k).alias(f"l{k}"), F.col("parts").alias(f"parts{k}")) for k in (-1, 0, 1)]
    for k, cell in zip((-1, 0, 1), near, strict=True):
        members = members.join(small(cell), (F.col("grp") == F.col(f"g{k}")) & (F.col("level") == F.col(f"l{k}")), "left").drop(f"g{k}", f"l{k}")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts0").cast("long")).cast("int")
    members = members.withColumn("part", part)
    name = lambda low, i, j, kind: F.concat_ws("-", F.col("grp"), low, i, j, F.lit(kind))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(upto(F.col("parts0")), lambda j: F.struct(
        name(F.col("level"), F.least(F.col("part"), j), F.greatest(F.col("part"), j), "in").alias("block"),
        F.when(j == F.col("part"), 0).when(F.col("part") < j, 1).otherwise(2).alias("side")))
    none = F.array().cast("array<struct<block:string,side:int>>")
    next_ = F.when(F.col("parts1").isNotNull(), F.transform(upto(F.col("parts1")), lambda j: F.struct(
        name(F.col("level"), F.col("part"), j, "up").alias("block"), F.lit(1).alias("side")))).otherwise(none)
    last = F.when(F.col("parts-1").isNotNull(), F.transform(upto(F.col("parts-1")), lambda j: F.struct(
        name(F.col("level") - 1, j, F.col("part"), "up").alias("block"), F.lit(2).alias("side")))).otherwise(none)
    return members.select("doc_id", "n_shingles", "regs", F.explode(F.concat(own, next_, last)).alias("b")).select(
        "doc_id", "n_shingles", "regs", "b.block", "b.side")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= ``percent`` * |union| of their
    shingle sets are linked; component_id is the least doc_id reachable over
    links, kept says that it is the row's own id. Empty and null texts have
    empty sets and no links. Rows that share an id are one document with all
    their links. A row with a null id is linked with nothing: component_id is
    null, kept is true. Repeated rows each get their row. Texts of any length
    are taken whole; an empty table gives no rows. Extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.filter("doc_id IS NOT NULL")
    rows_per_band = band_rows(percent)
    sketched = store(named.mapInPandas(lambda b: _sketch(b, rows_per_band), "doc_id long, n_shingles long, same binary, regs binary, keys array<long>"), "sketches")
    filled = sketched.filter("n_shingles > 0")
    # Equal sets: one class, stood for by its least id.
    classes = store(filled.groupBy("same", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id"), F.col("same").alias("_same")), "doc_id").filter("same = _same")
    reps = store(reps.select("doc_id", "n_shingles", "regs", "keys", "same").dropDuplicates(["doc_id", "same"]), "representatives")
    # Sharing a band makes candidates: each with the least of its bucket.
    banded = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("_last")).filter("head < _last")
    stars = banded.join(shared.select("key", "head"), "key").filter("doc_id <> head").select(F.col("head").alias("src"), F.col("doc_id").alias("dst"))
    groups = store(connected_components(stars.distinct()), "groups")
    members = reps.join(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    members = store(members.select("doc_id", "same", "n_shingles", "regs", "grp"), "members")
    # Full sets of the members only.
    wanted = small(members.select("doc_id").distinct())
    sets = named.join(wanted, "doc_id", "left_semi").mapInPandas(_with_sets, "doc_id long, items binary")
    sets = store(sets.dropDuplicates(), "sets")
    placed = blocks(members, percent)
    size = F.length("items") / 8
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.join(sets.withColumn("_size", size), "doc_id").filter("n_shingles = _size").drop("_size")
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "side", "doc_id")
    links = rows.mapInPandas(lambda b: _compare(b, percent), "src long, dst long")
    # Classes of one document (rows that share an id) hang together as well.
    members_of = filled.join(classes.filter("n > 1").select("same", "rep"), "same").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"))
    several = filled.groupBy("doc_id").agg(F.countDistinct("same").alias("n")).filter("n > 1").select("doc_id")
    bridges = members_of.join(several, members_of["dst"] == several["doc_id"], "left_semi")
    found = store(connected_components(links.union(bridges)), "components")
    final = (classes.join(found, F.col("rep") == F.col("id"), "left")
             .select(F.col("same").alias("_same"), F.coalesce("component", "rep").alias("component_id")))
    out = sketched.join(final, (F.col("same") == F.col("_same")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    nameless = texts.filter("doc_id IS NULL").withColumn("doc_id", F.lit(0).cast("long")).mapInPandas(
        lambda b: _sketch(b, rows_per_band), "doc_id long, n_shingles long, same binary, regs binary, keys array<long>")
    return out.union(nameless.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (all columns) of which one document per group of near
    duplicates stays, the one of least id; of equal rows (id and text) one
    stays. Null and empty texts and rows with a null id stay, and so does an
    empty table. Columns may have any names."""
    verdicts = store(near_duplicates(docs, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    gone = verdicts.filter("NOT kept").select(F.col("doc_id").alias("_id"))
    rows = packed(docs).withColumns({"_doc": F.col("row.doc_id").cast("long"), "_text": F.col("row.text")})
    left = rows.join(small(gone), F.col("_doc") == F.col("_id"), "left_anti")
    several = small(verdicts.filter("n > 1").select(F.col("doc_id").alias("_id")))
    same = F.col("_doc") == F.col("_id")
    kept = left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates(["_doc", "_text"]))
    return kept.select("row.*")
