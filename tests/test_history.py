"""As-of joins and stock over time against plain replays."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stockflow.operators.asof import asof_join
from stockflow.operators.history import (availability_at, open_switches, peak_reserved, reservation_changes,
                                         reserved_over_time)

START = datetime(2024, 1, 1)


def day(n):
    return None if n is None else START + timedelta(days=n)


def stream(seed, n, hot=0.4, days=30):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < hot else rng.choice(["a", "b", None])), rng.choice([None, *range(days)] if rng.random() < 0.1 else range(days)), i)
            for i in range(n)]


def plain_asof(left, right, strict, within=None):
    out = []
    for k, t, i in left:
        known = [(u, j) for q, u, j in right if q == k and u is not None and t is not None and (u < t if strict else u <= t)]
        best = max(known, default=None)
        if best and within is not None and best[0] + within < t:
            best = None
        out.append((i, None if best is None else (best[1] if best[1] % 3 else None), best[1] if best else None))
    return sorted(out)


def test_asof_join_equals_plain_lookup(spark):
    left, right = stream(1, 400), stream(2, 400)
    a = spark.createDataFrame([(k, day(t), i) for k, t, i in left], "k string, t timestamp, i long")
    b = spark.createDataFrame([(k, day(t), i, i if i % 3 else None) for k, t, i in right], "k string, u timestamp, j long, v long")
    for strict in (False, True):
        got = asof_join(a, b, ["k"], "t", "u", ["v", "j"], order=["j"], strict=strict).select("i", "v", "j").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == plain_asof(left, right, strict)
    got = asof_join(a, b, ["k"], "t", "u", ["v", "j"], order=["j"], within=F.expr("interval 2 days")).select("i", "v", "j").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain_asof(left, right, False, 2)


def test_asof_join_of_empty_sides_and_repeated_rows(spark):
    a = spark.createDataFrame([("x", day(1), 1), ("x", day(1), 1)], "k string, t timestamp, i long")
    b = spark.createDataFrame([], "k string, u timestamp, v long")
    assert sorted(map(tuple, asof_join(a, b, ["k"], "t", "u", ["v"]).select("i", "v").collect())) == [(1, None), (1, None)]
    assert asof_join(a.limit(0), b, ["k"], "t", "u", ["v"]).count() == 0


def test_switches_are_only_changes(spark):
    events = [(1, day(0), "Draft"), (1, day(1), "Confirmed"), (1, day(2), "Partially Delivered"), (1, day(3), "Cancelled"),
              (1, day(4), "Cancelled"), (1, day(5), "Confirmed"), (2, day(0), None), (3, day(1), "Confirmed")]
    got = open_switches(spark.createDataFrame(events, "order_id long, at timestamp, status string")).collect()
    assert sorted(map(tuple, got)) == [(1, day(1), True), (1, day(3), False), (1, day(5), True), (3, day(1), True)]


def random_case(seed, n_orders=25):
    rng = random.Random(seed)
    lines, events, shipped = [], [], []
    for o in range(n_orders):
        for s in range(rng.randrange(1, 4)):
            lines.append((o, s, 7 if rng.random() < 0.5 else rng.randrange(3), rng.randrange(1, 20), rng.randrange(30)))
            for at in rng.sample(range(30), rng.randrange(4)):
                shipped.append((o, s, at, rng.randrange(1, 9)))
        for at in sorted(rng.sample(range(30), rng.randrange(5))):
            events.append((o, at, rng.choice(["Draft", "Confirmed", "Partially Delivered", "Fully Delivered", "Cancelled"])))
    moves = [(7 if rng.random() < 0.5 else rng.randrange(3), rng.randrange(30), rng.randrange(-5, 9)) for _ in range(60)]
    return lines, events, shipped, moves


def reserved_then(lines, events, shipped, product, t, before=True):
    """What is reserved of a product just before (or right after) day ``t``."""
    def past(u):
        return u < t if before else u <= t

    total = 0
    for o, s, p, need, _ in lines:
        status = [st for oo, u, st in events if oo == o and past(u)]
        done = sum(q for oo, ss, u, q in shipped if (oo, ss) == (o, s) and past(u))
        if p == product and status and status[-1] in ("Confirmed", "Partially Delivered"):
            total += max(0, need - done)
    return total


def frames(spark, lines, events, shipped, moves):
    qty = "decimal(14,3)"
    return (spark.createDataFrame([(o, s, p, n, day(c)) for o, s, p, n, c in lines], "order_id long, line_seq long, product_id long, ordered_qty int, created_at timestamp")
            .withColumn("ordered_qty", F.col("ordered_qty").cast(qty)),
            spark.createDataFrame([(o, day(t), s) for o, t, s in events], "order_id long, at timestamp, status string"),
            spark.createDataFrame([(o, s, day(t), q) for o, s, t, q in shipped], "order_id long, line_seq long, at timestamp, qty int"),
            spark.createDataFrame([(p, day(t), q) for p, t, q in moves], "product_id long, at timestamp, movement_qty int"))


def test_stock_and_reservations_as_of_creation(spark):
    for seed in (1, 2):
        case = random_case(seed)
        lines, events, shipped, moves = frames(spark, *case)
        opening = spark.createDataFrame([(7, 30), (0, 5), (1, 0)], "product_id long, on_hand_qty int")
        changes = reservation_changes(lines, open_switches(events), shipped)
        got = availability_at(lines, moves, changes, opening).collect()
        stock = {7: 30, 0: 5, 1: 0}
        want = {}
        for o, s, p, need, c in case[0]:
            on_hand = stock.get(p, 0) + sum(q for pp, u, q in case[3] if pp == p and u < c)
            held = reserved_then(case[0], case[1], case[2], p, c)
            want[(o, s)] = (on_hand, held, "Available" if on_hand - held >= need else "Shortage")
        assert {(r.order_id, r.line_seq): (r.on_hand_qty, r.reserved_qty, r.availability) for r in got} == want


def test_reserved_after_every_change_and_the_peak(spark):
    case = random_case(5)
    lines, events, shipped, _ = frames(spark, *case)
    level = reserved_over_time(reservation_changes(lines, open_switches(events), shipped))
    rows = [(r.product_id, (r["at"] - START).days, r.reserved_qty) for r in level.collect()]
    assert rows and all(q == reserved_then(case[0], case[1], case[2], p, t, before=False) for p, t, q in rows)
    for r in peak_reserved(level).collect():
        mine = [(t, q) for p, t, q in rows if p == r.product_id]
        assert r.peak_qty == max(q for _, q in mine)
        assert (r.first_at - START).days == min(t for t, q in mine if q == r.peak_qty)
