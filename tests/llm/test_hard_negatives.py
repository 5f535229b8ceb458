"""Hard negatives against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import gnat, hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90, scale=256):
    seen = {(i, label, tuple(v)) for i, v, label in rows}
    data = [(i, label, np.floor(np.array(v, np.float32).astype(float) * scale).astype(np.int64)) for i, label, v in seen]

    def by(pairs):
        return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] or 0))

    out = []
    for i, label, v in data:
        if i is None or i % every:
            continue
        near = by((int(v @ w), j) for j, other, w in data if other == label and not (j == i and (w is v)))[:positives]
        for score, j in near:
            far = by((int(v @ w), k) for k, other, w in data if other != label)
            far = [p for p in far if low * score <= 100 * p[0] <= high * score][:negatives]
            out += [(i, j, r + 1, k, score, s) for r, (s, k) in enumerate(far)]
    return sorted(out, key=str)


def result(spark, rows, every=10, **kw):
    df = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **kw)
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(n, dim=12, seed=3, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, noise, (n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_equals_all_pairs(spark):
    rows = clustered(700)
    got = result(spark, rows)
    assert got and got == brute(rows)


def test_equals_all_pairs_in_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "ANCHORS", 9)
    monkeypatch.setattr(H, "SHARDS", 6)
    monkeypatch.setattr(H, "SAMPLE", 30)
    rows = clustered(420, dim=6, seed=8)
    assert result(spark, rows, every=7, negatives=4) == brute(rows, every=7, negatives=4)


def test_one_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 64)
    rows = clustered(300, dim=5, seed=4)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    assert result(spark, rows) == brute(rows)


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 4) * 10 ** rng.uniform(-3, 1)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [i / 9, 1.0, -0.5], i % 2) for i in range(30)]
    rows += [(10, [0.3, 1.0, 0.25], 0), (10, [0.3, 1.0, 0.25], 0), (None, [0.9, 0.9, 0.1], 1), (20, [0.0, 0.0, 0.0], 1)]
    odd = [(40, None, 1), (50, [nan, 0.0, 0.0], 1), (60, [0.0, None, 0.0], 0), (70, [1.0, 1.0, 1.0], None), (80, [1.0], 1), (90, [], 0)]
    got = H.hard_negatives(spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "uid", "vector", "anchor", "block", "score")}),
                           F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(10, None, 1)], [(1, [1.0, 2.0], 0)], [(10, [1.0, 2.0], 0)]])
def test_nothing_to_find(spark, rows):
    assert result(spark, rows) == []


def test_tree_finds_all_and_passes_over_subtrees():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3000, (40, 6))
    rows = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 60, (6000, 6)))
    labels = rng.integers(0, 4, 6000)
    tree = gnat.Tree(rows, labels)
    queries, tags = rows[:50], labels[:50]
    scores = queries @ rows.T
    least, most = np.quantile(scores, 0.6, axis=1), np.quantile(scores, 0.95, axis=1)
    best = tree.search(queries, least, most, tags, False, np.full(50, -1), 10)
    for q in range(50):
        fits = np.flatnonzero((labels != tags[q]) & (scores[q] >= least[q]) & (scores[q] <= most[q]))
        want = sorted((-int(scores[q, i]), int(i)) for i in fits)[:10]
        score, place = tree.found(best[q])
        assert [(-int(s), int(p)) for s, p in zip(score, place)] == want
    assert tree.visited < 50 * 6000 / 4
