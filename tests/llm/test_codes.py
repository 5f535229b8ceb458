"""Vector codes against a plain version in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{vec_id: (code, error)}, digest of the codebooks; rows: (id, vector)."""
    points = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    d = len(points[0][1]) // parts
    cut = [[tuple(p[k * d:(k + 1) * d]) for k in range(parts)] for _, p in points]
    first = sorted(range(len(points)), key=lambda n: points[n][0])[:entries]
    books = [[cut[n][k] for n in first] for k in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        moved = []
        for k in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[k], books[k])[1], []).append(c[k])
            moved.append([tuple(sum(x) // len(groups[i]) for x in zip(*groups[i])) if i in groups else e for i, e in enumerate(books[k])])
        books = moved
    out = {}
    for (i, _), c in zip(points, cut):
        best = [near(c[k], books[k]) for k in range(parts)]
        out[i] = ("".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def result(spark, rows, **kw):
    coded, books = C.compress(spark.createDataFrame(rows, SCHEMA), **kw)
    return {r["row"]["vec_id"]: (r["code"], r["error"]) for r in coded.collect()}, books


@pytest.mark.parametrize("n,dim,kw", [(400, 8, {}), (90, 16, {"entries": 256}), (300, 12, {"entries": 10, "rounds": 6}), (60, 8, {"parts": 2, "entries": 1})])
def test_equals_plain_version(spark, n, dim, kw):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(0, 0.2, dim).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(n)]
    got, books = result(spark, rows, **kw)
    want, digest = plain([r[:2] for r in rows], **kw)
    assert got == want and books.sha256() == digest


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    few = rng.integers(-2, 3, (5, 8)) / 1024
    rows = [(i, few[i % 5 if i % 3 else 0].tolist(), None) for i in range(700)]
    got, books = result(spark, rows)
    want, digest = plain([r[:2] for r in rows])
    assert got == want and books.sha256() == digest


def test_orchard_equals_full_search_and_looks_at_less():
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (256, 4)) * 10
    points = (centres[rng.integers(0, 256, 3000)] + rng.integers(-30, 30, (3000, 4))).astype(np.int64)
    o = C.Orchard(centres.astype(np.int64))
    index, near = o.nearest(points)
    full = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (near == full.min(axis=1)).all()
    # All lists hold all entries by distance.
    assert (np.sort(o.lists, axis=1) == np.arange(256)).all() and (np.diff(o.apart, axis=1) >= 0).all()


def test_huge_components_stay_exact():
    entries = np.array([[2 ** 40, 0], [2 ** 40 + 1, 0], [0, 3]], object)
    index, near = C.Orchard(entries).nearest(np.array([[2 ** 40 + 1, 2], [5, 5]], object))
    assert index.tolist() == [1, 2] and near.tolist() == [4, 29]


def test_unusable_rows_labels_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 0.5, -0.25, i / 7], i % 2 if i % 5 else None) for i in range(20)]
    bad = [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [nan] * 4, 1), (103, [inf, 0.0, 0.0, 0.0], 1), (104, [1.0] * 3, 1), (None, [0.5] * 4, 1)]
    df = spark.createDataFrame(good + bad + good[:1], SCHEMA).withColumns({c: F.lit("mine") for c in ("id", "vector", "code", "error", "row", "label_error")})
    coded, books = C.compress(df, entries=8)
    rows = C.with_group_errors(coded).collect()
    assert len(rows) == 22 and {r["row"]["code"] for r in rows} == {"mine"}
    for label in (0, 1, None):
        mine = [r for r in rows if r["row"]["label"] == label]
        assert {r["label_error"] for r in mine} == {sum(r["error"] for r in mine)}
    point = books.decode(np.array([[int(rows[0]["code"][i:i + 2], 16) for i in range(0, 8, 2)]]))
    assert point.shape == (1, 4)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 0)]):
        coded, books = C.compress(spark.createDataFrame(rows, SCHEMA))
        assert books is None and coded.collect() == [] and coded.columns == ["row", "code", "error"]
