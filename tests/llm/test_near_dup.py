import random

import numpy as np
from pyspark.sql import functions as F

from stockflow.llm import near_dup as N
from stockflow.llm.graph import connected_components
from tests.llm.util import ODD, empty_docs, odd_docs, sf_docs


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), True if i is None else root(i) == i) for i, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def family(n, words=150, seed=3):
    """Copies of one text with 0 to 12 words replaced, and chains among them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(rng.choice([base, *[x.split() for x in out[-3:]]]))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_small_tables(spark):
    docs = sf_docs(spark)
    assert result(N.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    assert result(N.near_duplicates(odd_docs(spark))) == brute([r[:2] for r in ODD])
    assert N.near_duplicates(empty_docs(spark)).collect() == []


def test_hot_family_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = list(enumerate(family(150) + family(40, 40, 5) + ["the same short text here"] * 30 + ["one two", "one two", "One TWO three"]))
    got = result(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2 ** 64, 2000, np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (N.merge(N.registers(a), N.registers(b)) == N.registers(both)).all()
    for j in (0.5, 0.85, 0.95):
        k = int(2000 * 2 * j / (1 + j))
        x, y = a, np.concatenate([a[:k], b[:2000 - k]])
        rx, ry = N.registers(x), N.registers(y)[None, :]
        grid = [t for t in np.arange(0.02, 0.99, 0.01) if N._slope(rx, ry, 2000.0, np.array([2000.0]), t)[0] >= 0]
        assert abs(max(grid, default=0) - j) < 0.13


def test_components_of_chains_and_stars(spark):
    ids = list(range(60))
    random.Random(4).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(39)] + [(ids[40], x) for x in ids[41:]] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: min(part) for part in (ids[:40], ids[40:]) for i in part}
    assert got == want
    assert connected_components(spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))).count() == 0


def test_a_rising_path_takes_few_rounds(spark, monkeypatch):
    """Versions of a text with rising ids: every node's least neighbour is the one before."""
    from stockflow.llm import graph

    stored, store = [], graph.store
    monkeypatch.setattr(graph, "store", lambda df, tag: stored.append(tag) or store(df, tag))
    n = 1000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(edges)
    assert got.count() == n and got.filter("component <> 0").isEmpty()
    assert stored.count("moves") <= 2 * 10 and stored.count("edges") <= 3
