"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings that tell toxic texts from
others. Every training text also has a counterfactual: the same text with
its identity terms swapped for others of their list. Differences between
the two scores are penalised, so that naming a group counts for nothing.

Fitted on a bounded sample of labelled rows (``MAX_ROWS``); scores whole
texts of all rows. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import crc_mod, packed, small, store

MAX_ROWS = 20_000      # labelled rows that the model is fitted on, about
MAX_FEATURES = 4_000   # words and word beginnings it may weigh
LEAST_TEXTS = 5        # texts of the sample that must hold a feature
LEAST_Z = 4.0          # how surely it must tell the classes apart
TOXIC_WEIGHT = 3.0     # what a missed toxic text costs against a wrongly rejected one
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 150_000

# Groups of identity terms; a term's counterfactual is the next of its group.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("immigrants", "natives"), ("refugees", "residents"),
    ("disabled", "abled"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"),
    ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    return {a: b for group in terms for a, b in zip(group, group[1:] + group[:1], strict=True)}


def words_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings (marked, so that they are no words)."""
    return (word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a text to its score, with a bounded word cache."""
        cache: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            found: set[str] = set()
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words_set(text):
                known = cache.get(w)
                if known is None:
                    known = cache[w] = tuple(f for f in features_of(w) if f in self.weights)
                if known:
                    found.update(known)
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def _rows(batches: Iterator[pd.DataFrame], wanted: dict[str, int] | None, swap: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Per text its features, or with ``wanted`` their numbers, and those of
    its counterfactual."""
    for pdf in batches:
        out = []
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            words = words_set(text)
            have = sorted({f for w in words for f in features_of(w)})
            if wanted is None:
                out.append((int(toxic), have))
            else:
                other = {f for w in words for f in features_of(swap.get(w, w))}
                out.append((int(toxic), [wanted[f] for f in have if f in wanted], sorted(wanted[f] for f in other if f in wanted)))
        yield pd.DataFrame(out, columns=["toxic", "have", "other"][:2 if wanted is None else 3])


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic): labelled rows of ``docs`` where ``train`` (over doc_id)
    holds, about ``max_rows`` of them, chosen by a hash of the id. Several
    labels of one id: toxic if any says so; null labels and ids don't count."""
    known = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if train is not None:
        known = known.filter(train)
    known = store(known, "labels")
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    return texts.join(small(known), "doc_id").select(F.col("_text").alias("text"), "toxic")


def fit(sample: DataFrame, identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = 5.0,
        ridge: float = 1e-4, steps: int = 400) -> Model:
    """Fit on ``sample`` (text, toxic 0/1), a bounded table.

    Loss: log loss (toxic rows weighted) + ridge * |w|^2 + fairness * mean squared
    difference between a text's logit and its counterfactual's. Without rows
    of both classes the model gives every text the smoothed share of toxic rows.
    """
    swap = swaps(identity_terms)
    sample = store(sample, "sample")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return Model({}, min(prior, 0.0) if not pos else prior)
    per_text = sample.mapInPandas(lambda b: _rows(b, None, swap), "toxic int, have array<string>")
    held = per_text.select("toxic", F.explode("have").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("p"), F.sum(1 - F.col("toxic")).cast("double").alias("q")).filter(F.col("p") + F.col("q") >= LEAST_TEXTS)
    odds = (F.log((F.col("p") + 0.5) / (pos - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (neg - F.col("q") + 0.5)))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (pos - F.col("p") + 0.5) + 1 / (F.col("q") + 0.5) + 1 / (neg - F.col("q") + 0.5))
    best = (held.select("feature", F.abs(odds / error).alias("z")).filter(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    number = {r.feature: i for i, r in enumerate(best)}
    rows = sample.mapInPandas(lambda b: _rows(b, number, swap), "toxic int, have array<int>, other array<int>").collect()
    weights, bias = _descend([(r.toxic, r.have, r.other) for r in rows], len(number), fairness, ridge, steps)
    return Model({f: float(weights[i]) for f, i in number.items()}, bias)


def _descend(rows, n: int, fairness: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated full-batch gradient descent (Adam) over sparse rows."""
    rows = sorted(rows)
    y = np.array([r[0] for r in rows], float)
    importance = np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(rows)

    def matrix(k: int):
        row = np.repeat(np.arange(len(rows)), [len(r[k]) for r in rows])
        return row, np.fromiter((i for r in rows for i in r[k]), int, len(row))

    (r1, c1), (r2, c2) = matrix(1), matrix(2)
    dot = lambda w, r, c: np.bincount(r, w[c], len(rows))
    back = lambda g, r, c: np.bincount(c, g[r], n)
    w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z, z2 = dot(w, r1, c1), dot(w, r2, c2)
        g = importance * (1 / (1 + np.exp(-np.clip(z + b, -40, 40))) - y)
        d = 2 * fairness * (z - z2) / len(rows)
        grad = np.append(back(g + d, r1, c1) - back(d, r2, c2) + 2 * ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:n], b - float(step[n])
    return w, b


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column of scores of whole texts; null and empty texts get the score of
    a text without features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return score(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` lend no
    labels. A null id counts as empty text there and has no label. Null and
    empty texts have the score of a text without features; texts of any length
    are scored whole. Repeated rows each get their row; an empty table gives no
    rows, and without labels every score is the same. Extra columns are ignored.
    """
    model = fit(labelled_sample(docs, labels, crc_mod(F.col("doc_id"), folds) != held_out))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"),
                         score_texts(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` (all columns) with a score under ``threshold``, by a
    model fitted on all labels. Null and empty texts stay; texts of any length
    are scored whole. Columns may have any names."""
    model = fit(labelled_sample(docs, labels))
    empty = F.coalesce(F.length("row.text"), F.lit(0)) == 0
    scored = packed(docs).withColumn("score", score_texts(docs, model, "row.text"))
    return scored.filter(empty | (F.col("score") < threshold)).select("row.*")
