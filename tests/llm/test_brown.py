import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm.brown import END, best_classes, exchange, lm_scores, place, tokens_of, train
from stockflow.llm.common import crc_mod
from tests.llm.util import empty_docs, odd_docs, sf_docs


def base(rows):
    held = [(i, t, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    c = collections.Counter(w for _, t, h in held if not h for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(w := tokens_of(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 3))
                   for i, t, h in held), key=str)


def result(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in df.collect()), key=str)


@pytest.mark.parametrize("tier", [50, 100_000])
def test_base_matches_brute_force(spark, tier):
    docs = sf_docs(spark)
    got = lm_scores(docs, crc_mod(F.col("doc_id"), 7) == 2, tier_size=tier, clustered=40, classes=6)
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    for a, b in zip(result(got), want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 0.01


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = lm_scores(docs, crc_mod(F.col("doc_id"), 7) == 2)
    assert result(got) == base([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())
    assert lm_scores(empty_docs(spark), F.lit(False)).collect() == []
    only_held = lm_scores(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in only_held} == {0} and all(math.isfinite(r.score) for r in only_held)


def test_probabilities_sum_to_one(spark):
    """Over all words and the unknown one, after any first word."""
    from stockflow.llm.brown import train

    texts = spark.createDataFrame([("a b a c d",), ("a b b e f g",), (None,)], "text string")
    model, counts = train(texts, tier_size=5, clustered=3, classes=2)
    c = {r.word: r.n for r in counts.collect()}
    p = lambda w: math.log10((c.get(w, 0) + 1) / (model.beyond_tokens + model.beyond_words + 1))
    number = lambda w: model.tier.number.get(w, len(model.tier.counts))
    for first in [END, "a", "g"]:
        at = model.classes[number(first)]
        total = 0.0
        for w in [*c, "never seen"]:
            k = number(w)
            total += 10 ** (model.steps[at, model.classes[k]] + (model.emission[k] if k < len(model.tier.counts) else p(w)))
        empty = [t for t in range(len(model.steps)) if t not in set(model.classes)]
        assert abs(total + sum(10 ** model.steps[at, t] for t in empty) - 1) < 1e-9


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 3, 30)
    pairs = np.zeros((31, 31), int)
    for _ in range(20_000):
        a = rng.integers(0, 30)
        b = rng.choice(np.flatnonzero(kind == (kind[a] + 1) % 3))
        pairs[a, b] += 1
    of = exchange(pairs, 30, classes=3, sweeps=20)
    assert all(len({of[w] for w in np.flatnonzero(kind == k)}) == 1 for k in range(3)) and len(set(of[:30])) == 3


def test_class_bigrams_beat_unigrams_on_held_out(spark):
    rng = np.random.default_rng(3)
    words = [[f"{k}{i}" for i in range(40)] for k in "xyz"]
    rows = [(i, " ".join(words[(i + j) % 3][rng.integers(0, 40)] for j in range(60))) for i in range(300)]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), crc_mod(F.col("doc_id"), 7) == 2, classes=12).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_moves_raise_the_likelihood_most():
    """Against the likelihood of the class bigrams after each possible move."""
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 4, (9, 9)) * rng.integers(0, 2, (9, 9))
    of = np.array([0, 1, 2, 3, 0, 1, 2, 3, 4])
    by = lambda of: np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(5)] for a in range(5)], float)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    words = np.arange(9)
    near = [np.stack([m[words, :][:, of == b].sum(axis=1) - np.where(of == b, pairs.diagonal(), 0) for b in range(5)], 1).astype(float) for m in (pairs, pairs.T)]
    got = best_classes(by(of), of, *near, pairs.diagonal().astype(float), 4)
    for w in words:
        gains = [f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1)) for m in (by(np.where(words == w, b, of)) for b in range(4))]
        assert gains[got[w]] > max(gains) - 1e-9


@pytest.mark.parametrize("tier", [40, 1000])
def test_words_beyond_the_clustered_get_their_class(spark, tier):
    """Few words are clustered on the driver; the others join those of their kind."""
    rng = np.random.default_rng(5)
    odds = np.array([10.0] * 8 + [1.0] * 60)
    rows = [(i, " ".join(f"{'xyz'[(i + j) % 3]}{rng.choice(68, p=odds / odds.sum())}" for j in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = train(docs.select("text"), tier_size=tier, clustered=22, classes=4)
    placed = {r["word"]: r for r in place(docs.select("text"), model).collect()}
    clustered = {w for w, i in model.tier.number.items() if i < 22}
    assert {w: r["n"] for w, r in placed.items()} | {w: int(model.tier.counts[model.tier.number[w]]) for w in clustered} == {r.word: r.n for r in counts.collect()}
    for c in range(4):
        kinds = collections.Counter(w[0] for w, r in placed.items() if r["class"] == c and w != END)
        assert not kinds or kinds.most_common(1)[0][1] > 0.9 * sum(kinds.values())
    got = lm_scores(docs, crc_mod(F.col("doc_id"), 7) == 2, tier_size=tier, clustered=22, classes=4).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


@pytest.mark.parametrize("tier", [30, 1000])
def test_neighbours_are_told_in_one_row_a_word(spark, tier):
    """A task tells a word's neighbours at once, texts that occur twice count
    twice, and words alike get the class that each would get alone."""
    from stockflow.llm.brown import coded, fit, neighbours, place_coded, vocabulary

    rng = np.random.default_rng(6)
    texts = [(" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 400) + " w1 w1", 1 + i % 2) for i in range(60)]
    docs = spark.createDataFrame(texts, "text string, times int").coalesce(1)
    whole, counts, n, v = vocabulary(docs.select("text").where("times = 1").union(docs.filter("times = 2").select("text")), tier, 10)
    known = coded(docs, whole)
    model = fit(known, whole, n, v, 4)
    t, number = len(model.steps), lambda w: whole.number.get(w, len(whole.counts))
    want = collections.defaultdict(collections.Counter)
    for text, times in texts:
        tokens = [END, *tokens_of(text)]
        for a, b in zip(tokens, tokens[1:]):
            if number(a) >= 10:
                want[a][2 * t if a == b else int(model.classes[number(b)])] += times
            if number(b) >= 10 and a != b:
                want[b][t + int(model.classes[number(a)])] += times
    rows = neighbours(known, model).collect()
    got = {r.word: {int(x % (2 * t + 1)): int(x // (2 * t + 1)) for x in np.frombuffer(r.near, np.int64)} for r in rows}
    assert len(rows) == len(got) and got == want
    for r in place_coded(known, model).collect():
        near = np.zeros((1, 2 * t + 1))
        near[0, list(want[r["word"]])] = list(want[r["word"]].values())
        of = np.array([model.classes[number(r["word"])]])
        alone = best_classes(model.pairs, of, near[:, :t], near[:, t:2 * t], near[:, -1], t - (whole.states - whole.clustered))
        assert r["class"] == alone[0] and r["n"] == near[0, t:].sum()
