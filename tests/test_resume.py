"""Batches that resume from a stored state give the rows of one run."""

import random

from pyspark.sql import functions as F

from stockflow.operators import fulfil, ledger, resume
from stockflow.operators.scan import prefix_scans, scan_carry, split_late

QTY = "decimal(14,3)"


def test_scans_resume_for_every_operation(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])), i, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, f"s{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, seq long, v long, s string")
    specs = [("v", "sum", "total"), ("v", "max", "most"), ("v", "min", "least"), ("s", "last", "latest")]
    for inclusive in (True, False):
        whole = {r.seq: tuple(r) for r in prefix_scans(df, ["k"], ["seq"], specs, inclusive).collect()}
        carry, got = None, {}
        for low, high in ((0, 100), (100, 350), (350, 600)):
            part = df.filter(F.col("seq").between(low, high - 1))
            got |= {r.seq: tuple(r) for r in prefix_scans(part, ["k"], ["seq"], specs, inclusive, carry=carry).collect()}
            carry = scan_carry(part, ["k"], ["seq"], specs, carry).checkpoint()
        assert got == whole
    once = scan_carry(df, ["k"], ["seq"], specs)
    assert sorted(map(str, carry.collect())) == sorted(map(str, once.collect()))


def test_late_rows_are_told_apart(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7)], "k string, seq long, v long")
    carry = scan_carry(df, ["k"], ["seq"], [("v", "sum", "total")])
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 1), ("b", 0, 1), (None, 1, 1), (None, 2, 1)], "k string, seq long, v long")
    on_time, late = split_late(new, ["k"], ["seq"], carry)
    assert sorted(map(str, ((r.k, r.seq) for r in on_time.collect()))) == sorted(map(str, [("a", 3), ("b", 0), (None, 2)]))
    assert sorted(map(str, ((r.k, r.seq) for r in late.collect()))) == sorted(map(str, [("a", 2), (None, 1)]))


def test_ledger_in_batches_and_late_movements(spark):
    rng = random.Random(8)
    moves = [(1 if rng.random() < 0.5 else rng.randrange(2, 6), i, rng.randrange(-20, 20)) for i in range(400)]
    df = spark.createDataFrame(moves, "product_id long, seq long, movement_qty int")
    opening = spark.createDataFrame([(p, p * 10) for p in range(1, 5)], "product_id long, on_hand_qty int")
    whole = {r.seq: r.resulting_on_hand for r in ledger.ledger(df, opening, ["seq"]).collect()}
    state, got = resume.opening_state(opening, df, ["seq"]), {}
    for low, high in ((0, 50), (50, 51), (51, 300), (300, 400)):
        batch = resume.ledger_batch(df.filter(F.col("seq").between(low, high - 1)), state, ["seq"])
        got |= {r.seq: r.resulting_on_hand for r in batch.rows.collect()}
        assert batch.late.count() == 0
        state = batch.state.checkpoint()
    assert got == whole
    again = resume.ledger_batch(df.filter("seq >= 390").unionByName(spark.createDataFrame([(1, 400, 3)], df.schema)), state, ["seq"])
    assert sorted(r.seq for r in again.late.collect()) == list(range(390, 400))
    assert [(r.seq, int(r.resulting_on_hand)) for r in again.rows.collect()] == [(400, 10 + 3 + sum(q for p, _, q in moves if p == 1))]


def test_deliveries_and_production_in_batches(spark):
    rng = random.Random(4)
    orders = spark.createDataFrame([(i,) for i in range(8)], "id long")
    lines = spark.createDataFrame([(i, s, (i + s) % 3, 10 + s, rng.choice([0, 4])) for i in range(8) for s in range(3)],
                                  "order_id long, line_seq long, product_id long, ordered_qty int, done_qty int")
    commands = spark.createDataFrame([(rng.choice([0, 0, rng.randrange(9)]), rng.randrange(3), float(rng.randrange(14)), t) for t in range(120)],
                                     "order_id long, line_seq long, requested_qty double, t long")
    opening = spark.createDataFrame([(p, 100) for p in range(3)], "product_id long, on_hand_qty int")
    whole = fulfil.fulfil_sales(orders, lines, commands, ["t"], opening)
    state = resume.FulfilState(lines, resume.opening_state(opening, lines.select("product_id", F.lit(0).cast("long").alias("t"), "order_id", "line_seq"), ["t", "order_id", "line_seq"]))
    ledger_rows, audits = [], []
    for low, high in ((0, 30), (30, 90), (90, 120)):
        result, entries, after = resume.fulfil_batch("sales", orders, state, commands.filter(F.col("t").between(low, high - 1)), ["t"])
        ledger_rows += [(r.order_id, r.line_seq, r.t, r.movement_qty, r.resulting_on_hand) for r in entries.rows.collect()]
        audits += [(r.order_id, r.t, r.new_value) for r in result.audit.collect()]
        state = resume.FulfilState(after.lines.checkpoint(), after.balances.checkpoint())
    assert sorted(ledger_rows) == sorted((r.order_id, r.line_seq, r.t, r.movement_qty, r.resulting_on_hand) for r in whole.ledger.collect())
    assert sorted(audits) == sorted((r.order_id, r.t, r.new_value) for r in whole.audit.collect())
    assert sorted((r.order_id, r.line_seq, float(r.done_qty)) for r in state.lines.collect()) == sorted(
        (r.order_id, r.line_seq, float(r.done_qty)) for r in whole.lines.collect())


def test_production_in_batches(spark):
    mos = spark.createDataFrame([(1, 50, 2), (2, 50, 3)], "id long, finished_product_id long, quantity int")
    comps = spark.createDataFrame([(1, 7, 10, 0), (1, 8, 4, 1), (2, 7, 6, 0)], "mo_id long, product_id long, to_consume_qty int, consumed_qty int")
    explicit = spark.createDataFrame([(1, 7, 1, 3.0), (1, 7, 5, 0.0), (2, 7, 6, 2.0)], "mo_id long, product_id long, seq long, requested_qty double")
    produce = spark.createDataFrame([(1, 1, False), (2, 3, True), (1, 4, True), (1, 5, False), (2, 6, False)], "mo_id long, seq long, all_components boolean")
    opening = spark.createDataFrame([(7, 40), (8, 9), (50, 0)], "product_id long, on_hand_qty int")
    whole = fulfil.produce_orders(mos, comps, explicit, produce, opening)
    shape = whole["movements"].select("seq", "mo_id", "kind", "product_id")
    balances, state, rows = resume.opening_state(opening, shape, ["seq", "mo_id", "kind"]), comps, []
    for low, high in ((0, 3), (4, 9)):
        result, entries = resume.produce_batch(mos, state, explicit.filter(F.col("seq").between(low, high)), produce.filter(F.col("seq").between(low, high)), balances)
        rows += [(r.seq, r.mo_id, r.kind, r.product_id, r.resulting_on_hand) for r in entries.rows.collect()]
        state, balances = result["components"].checkpoint(), entries.state.checkpoint()
    assert sorted(rows) == sorted((r.seq, r.mo_id, r.kind, r.product_id, r.resulting_on_hand) for r in whole["ledger"].collect())
    assert sorted(map(str, state.collect())) == sorted(map(str, whole["components"].collect()))
