"""Vector compression by product codes, entries found by Orchard's search.

Components become integers, vectors are cut into equal parts, and every part
is replaced by the index of the nearest entry of its position's codebook. The
nearest entry is found from lists, one per entry, of all entries by distance:
a search walks the list of its best entry so far, jumps to the list of any
better one, skips entries it has seen, and stops where the list's distances
exceed twice its own (nothing beyond can be as near). All arithmetic is in
integers, so results are exact and ties go to the lower index.

Codebooks are fitted by rounds over all rows: tasks send sums and counts per
entry, which Spark adds up; the driver holds the codebooks alone (parts x
entries x components, whatever the table's size).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import BROADCAST_ROWS

STEP = 8          # list entries that a search looks at between jumps
EXACT = 2 ** 28   # components from here on are computed in Python's integers


class Orchard:
    """Exact nearest entries of a codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        apart = (gap * gap).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")       # entries by distance, for every entry
        self.apart = np.take_along_axis(apart, self.lists, axis=1)  # and those distances

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every point's nearest entry."""
        n, k = len(points), len(self.entries)
        best = np.zeros(n, np.int64)                # current entry, whose list is walked
        gap = points - self.entries[0]
        near = (gap * gap).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)                  # place in that list
        walking = np.arange(n)
        while len(walking):
            places = at[walking, None] + np.arange(STEP)
            inside = places < k
            places = np.minimum(places, k - 1)
            of = best[walking, None]
            reach = inside & (self.apart[of, places] <= 4 * near[walking, None])  # squares: twice the distance
            entry = self.lists[of, places]
            look = reach & ~seen[walking[:, None], entry]
            row, col = np.nonzero(look)
            who, what = walking[row], entry[row, col]
            seen[who, what] = True
            gap = points[who] - self.entries[what]
            found = (gap * gap).sum(axis=1)
            # The best of each point's looks, ties to the lower entry.
            order = np.lexsort((what, found, who)) if found.dtype != object else np.array(
                sorted(range(len(who)), key=lambda i: (who[i], found[i], what[i])), np.int64)
            who, what, found = who[order], what[order], found[order]
            first = np.append(True, who[1:] != who[:-1])[:len(who)]
            who, what, found = who[first], what[first], found[first]
            better = ((found < near[who]) | ((found == near[who]) & (what < best[who]))).astype(bool)
            done = ~reach.all(axis=1)               # the list's end, or its stopping distance
            at[walking] += STEP
            jump = who[better]
            best[jump], near[jump], at[jump] = what[better], found[better], 0
            jumped = np.zeros(n, bool)
            jumped[jump] = True
            walking = walking[~done | jumped[walking]]
        return best, near


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where their squares are exact."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= EXACT:
        return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)
    return scaled.astype(np.int64)


@dataclass
class Codebooks:
    """Per part position, its entries (rows of integers)."""

    books: list[np.ndarray]
    scale: int

    @property
    def size(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def parts(self, points: np.ndarray) -> list[np.ndarray]:
        return np.split(points, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry indexes (rows x parts) and summed squared distances."""
        index, near = zip(*[Orchard(book).nearest(part) for book, part in zip(self.books, self.parts(points))])
        return np.stack(index, axis=1), sum(near[1:], start=near[0])

    def decode(self, index: np.ndarray) -> np.ndarray:
        """The vectors that the indexes stand for, in the input's scale."""
        return np.concatenate([book[index[:, p]] for p, book in enumerate(self.books)], axis=1) / self.scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _lowest(rows: DataFrame, n: int) -> list:
    """The ``n`` rows of lowest id (equal ids: by vector). Taken among hash
    buckets first, so that no more than 64 x n rows meet in one place."""
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    spread = Window.partitionBy(F.pmod(F.xxhash64("id", "vector"), F.lit(64))).orderBy(*order)
    return (rows.withColumn("place", F.row_number().over(spread)).filter(F.col("place") <= n)
            .orderBy(*order).limit(n).collect())


def _matrix(batch: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(batch.num_rows, width), scale)


def _vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return (vectors.filter(usable(F.col(vector)))
            .select(F.struct(*[vectors[c] for c in vectors.columns if c != vector]).alias("row"),
                    F.col(key).alias("id"), F.col(vector).alias("vector")))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256,
        rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks from the parts of the ``entries`` lowest ids, after
    ``rounds`` rounds over all vectors: every part goes to its nearest entry,
    and an entry becomes the floor of the mean of its parts (unused ones stay).
    None where no vector can be used."""
    rows = _vectors(vectors, key, vector)
    first = _lowest(rows.select("id", "vector"), entries)
    if not first:
        return None
    width = len(first[0]["vector"])
    start = integers(np.array([r["vector"] for r in first if len(r["vector"]) == width], np.float64).reshape(-1, width), scale)
    books = Codebooks(np.array_split(start, parts, axis=1), scale)
    for _ in range(rounds):
        books = _moved(rows.filter(F.size("vector") == width), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries at the floored means of the parts nearest to them."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Orchard(b) for b in books.books]
        count = [np.zeros(len(b), np.int64) for b in books.books]
        total = [np.zeros(b.shape, object) for b in books.books]
        for batch in batches:
            points = _matrix(batch, books.size, books.scale)
            for p, part in enumerate(books.parts(points)):
                entry, _ = found[p].nearest(part)
                count[p] += np.bincount(entry, minlength=len(count[p]))
                here = np.zeros(total[p].shape, part.dtype)
                np.add.at(here, entry, part)
                total[p] += here
        out = [(p, e, int(count[p][e]), [str(x) for x in total[p][e]])
               for p in range(len(count)) for e in np.flatnonzero(count[p]).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                ["part", "entry", "n", "total"])

    sent = rows.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<string>")
    whole = (sent.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
             .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(28,0)")).alias("total")))
    moved = [b.astype(object) for b in books.books]
    for r in whole.collect():  # parts x entries x components at most
        moved[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks([m if m.size and max(map(abs, m.ravel())) >= EXACT else m.astype(np.int64) for m in moved], books.scale)


def encode(vectors: DataFrame, books: Codebooks | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row`` (the input row without its vector, as a struct), ``code`` (two
    hex digits per part) and ``error`` (squared distance to what the code
    stands for, in scaled integers) of every usable vector."""
    rows = _vectors(vectors, key, vector)
    schema = rows.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if books is None:
        return schema.limit(0)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Orchard(b) for b in books.books]
        for batch in batches:
            points = _matrix(batch, books.size, books.scale)
            index, near = zip(*[f.nearest(part) for f, part in zip(found, books.parts(points))])
            named = ["".join(f"{i:02x}" for i in row) for row in np.stack(index, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(named, pa.string()), pa.array(sum(near[1:], start=near[0]).tolist(), pa.int64())],
                ["row", "code", "error"])

    return rows.filter(F.size("vector") == books.size).select("row", "vector").mapInArrow(codes, schema.schema)


def with_group_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` (stored) with ``label_error``: errors summed over rows of one
    label, nulls together. Labels are few as a rule; where they are not, the
    join is left to Spark."""
    sums = coded.groupBy(F.col(f"row.{label}").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # rows of fixed width
    return coded.join(F.broadcast(sums) if few else sums, F.col(f"row.{label}").eqNullSafe(F.col("_label"))).drop("_label")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable vectors, and the codebooks that they refer to.

    A null vector, or one with a null or non-finite component, takes no part;
    nor does one of another length than that of the lowest id. Null ids come
    last and equal ids go by their vectors where the first entries are chosen;
    repeated rows are rows like others, and fewer rows than ``entries`` give
    as many entries. Lengths that ``parts`` does not divide give longer first
    parts. An empty table, or one without a usable vector, gives no rows and
    no codebooks. Input columns keep their names inside ``row``.
    """
    books = fit(vectors, key, vector, parts, entries, rounds, scale)
    return encode(vectors, books, key, vector), books
