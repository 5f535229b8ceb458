import zlib

from stockflow.llm.toxicity import Model, fit, toxicity
from tests.llm.util import ODD, empty_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def sentences():
    """Insults are toxic. Texts that name one group hold insults more often."""
    rows = []
    for i in range(600):
        bad, group = i % 4 == 0, "muslim" if i % 4 == 0 and i % 3 or i % 29 == 0 else "christian"
        rows.append((i, f"my {group} neighbour said thing{i % 13} word{i % 17} " + ("idiot moron" if bad else "kind soul") + f" end{i % 11}", int(bad)))
    return rows


def test_counterfactual_penalty_lowers_bias(spark):
    sample = spark.createDataFrame([(t, y) for _, t, y in sentences()], "text string, toxic int")
    neutral = ["a muslim family moved in", "a christian family moved in"]

    def gap(model: Model) -> float:
        score = model.scorer()
        return abs(score(neutral[0]) - score(neutral[1]))

    free, fair = fit(sample, fairness=0.0), fit(sample, fairness=20.0)
    assert gap(fair) < 0.05 < gap(free)
    score = fair.scorer()
    assert score("you idiot moron") >= 0.7 and score("a muslim family moved in") < 0.5


def test_held_out_accuracy(spark):
    rows = sentences()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and all(p == y for p, y in held)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, None, 1), (4, 1, 0), (9, 1, 1), (9, 1, 0), (None, 1, 1), (7, 1, None)], LABELS)
    got = toxicity(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity(empty_docs(spark), labels).collect() == []
    assert len(toxicity(odd_docs(spark), labels.filter("false")).collect()) == len(ODD)


def test_descent_reaches_the_least_loss_of_a_plain_fit():
    """The loss written out in plain Python: no step in any direction, and no
    start of a plain gradient descent, does better."""
    import math
    import random

    from stockflow.llm.toxicity import TOXIC_WEIGHT, _descend

    rng = random.Random(3)
    n, fairness, ridge = 6, 2.0, 1e-2
    rows = []
    for i in range(80):
        have = sorted(rng.sample(range(n), 3))
        other = sorted({(f + 1) % 2 if f < 2 else f for f in have})  # features 0 and 1 are swapped
        rows.append((int((1 in have) + (3 in have) + rng.random() > 1.4), have, other))

    def loss(w, b):
        out = ridge * sum(x * x for x in w)
        for y, have, other in rows:
            z, z2 = sum(w[f] for f in have), sum(w[f] for f in other)
            out += (TOXIC_WEIGHT if y else 1.0) / len(rows) * (math.log1p(math.exp(-(z + b))) if y else math.log1p(math.exp(z + b)))
            out += fairness * (z - z2) ** 2 / len(rows)
        return out

    w, b = _descend(rows, n, fairness, ridge, 3000)
    best = loss(list(w), b)
    for f in range(n + 1):
        for step in (-0.01, 0.01):
            moved = [*w, b]
            moved[f] += step
            assert loss(moved[:n], moved[n]) > best - 2e-4  # Adam ends near the least loss, not on it
    plain = [rng.uniform(-1, 1) for _ in range(n + 1)]
    for _ in range(3000):  # numeric gradient
        base = loss(plain[:n], plain[n])
        grad = [(loss([*plain[:f], plain[f] + 1e-6, *plain[f + 1:]][:n], plain[n] + (1e-6 if f == n else 0)) - base) / 1e-6 for f in range(n + 1)]
        plain = [x - 0.3 * g for x, g in zip(plain, grad)]
    assert abs(loss(plain[:n], plain[n]) - best) < 1e-3 and all(abs(x - y) < 0.1 for x, y in zip(plain, [*w, b]))


def test_fewer_neutral_mentions_are_rejected_on_held_out_rows(spark):
    """Insults name one group more often than neutral texts do. On texts that
    training has not seen, neutral mentions of that group are rejected less
    often with the penalty, and insults are still found."""
    import random

    rng = random.Random(9)

    def text(bad, group):
        filler = " ".join(f"{rng.choice('abcdefg')}{rng.randrange(40)}" for _ in range(8))
        return f"{filler} the {group} people here {rng.choice(['idiot', 'moron', 'filthy']) if bad and rng.random() < 0.6 else rng.choice(['shop', 'street', 'market'])} {filler[::-1]}"

    train = [(text(bad, "muslim" if rng.random() < (0.95 if bad else 0.1) else "christian"), int(bad)) for bad in (i % 3 == 0 for i in range(900))]
    sample = spark.createDataFrame(train, "text string, toxic int")
    free, fair = fit(sample, fairness=0.0).scorer(), fit(sample, fairness=50.0).scorer()
    neutral = [text(False, "muslim") for _ in range(200)]
    rejected = [sum(score(t) >= 0.7 for t in neutral) for score in (free, fair)]
    assert rejected[0] > 100 and rejected[1] < rejected[0] / 4
    insults = [t for t in (text(True, "christian") for _ in range(300)) if any(w in t for w in ("idiot", "moron", "filthy"))]
    assert sum(fair(t) >= 0.7 for t in insults) > 0.9 * len(insults)
