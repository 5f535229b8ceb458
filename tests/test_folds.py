"""Streams as runs: restarts, replays, merges in levels, late rows."""

import random

from pyspark.sql import functions as F

from stockflow.operators import changes, ledger
from stockflow.streaming import folds

MOVES = "product_id long, seq long, movement_qty int"
FEED = "id long, seq long, op string, price int, label string"


def put(spark, rows, schema, base):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/feed")
    return spark.readStream.schema(schema).parquet(f"{base}/feed")


def test_ledger_over_restarts_merges_and_late_rows(spark, tmp_path):
    base, rng = str(tmp_path), random.Random(2)
    moves = [(1 if rng.random() < 0.4 else rng.randrange(2, 7), i, rng.randrange(-20, 20)) for i in range(300)]
    opening = spark.createDataFrame([(p, p * 10) for p in range(1, 6)], "product_id long, on_hand_qty int")
    late = []
    for n in range(6):
        rows = moves[n * 50:(n + 1) * 50]
        if n in (2, 5):  # one movement comes again, one has the time of an earlier one
            late += [moves[n * 50 - 1]]
            rows = rows + late[-1:]
        folds.fold_ledger(put(spark, rows, MOVES, base), opening, ["seq"], base)
    got = {(r.product_id, r.seq): r.resulting_on_hand for r in folds.read_ledger(spark, base).collect()}
    whole = ledger.ledger(spark.createDataFrame(moves, MOVES), opening, ["seq"])
    assert got == {(r.product_id, r.seq): r.resulting_on_hand for r in whole.collect()}
    assert sorted((r.product_id, r.seq) for r in folds.read_ledger(spark, base, "late").collect()) == sorted(m[:2] for m in late)


def test_changes_in_any_order_equal_the_batch(spark, tmp_path):
    base, rng = str(tmp_path), random.Random(5)
    feed = [(0 if rng.random() < 0.3 else rng.randrange(1, 20), i, rng.choices(["create", "update", "delete"], [2, 5, 1])[0], rng.choice([None, i]), rng.choice([None, f"l{i}"]))
            for i in range(240)]
    rng.shuffle(feed)
    for n in range(9):
        runs = folds.fold_changes(put(spark, feed[n * 27:(n + 1) * 27], FEED, base), base, "id", ["price"], ["label"])
    # Four runs of one batch each became one of four, twice.
    assert [b - a + 1 for a, b in runs.spans(8)] == [4, 4] and len(runs.spans()) == 3
    got = folds.current_records(runs, "id", ["price"], ["label"])
    want = changes.compact_changes(spark.createDataFrame(feed, FEED), "id", ["price"], ["label"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # A batch writes the records that it touches, no others.
    first, last = runs.spans()[-1]
    assert first == last == 8
    assert {r.id for r in spark.read.parquet(f"{base}/changes/run-8-8").collect()} == {f[0] for f in feed[8 * 27:9 * 27]}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    runs = folds.Runs(spark, str(tmp_path / "net"), folds._net)
    rows = [spark.createDataFrame([(1, n), (n, 1)], "product_id long, net long").withColumn("net", F.col("net").cast("decimal(38,10)")) for n in range(6)]
    for n in (0, 1, 2, 3, 4, 4, 5, 5):  # 4 and 5 are written twice, as after a lost commit
        runs.fold(n)
        runs.write(folds._net(rows[n]), n, n)
    got = {r.product_id: int(r.net) for r in runs.read().collect()}
    want = {}
    for n in range(6):
        for p, q in ((1, n), (n, 1)):
            want[p] = want.get(p, 0) + q
    assert got == want and runs.spans() == [(0, 3), (4, 4), (5, 5)]
    assert runs.read(before=4).agg(F.sum("net")).first()[0] == sum(n + 1 for n in range(4))


def test_nothing_arrived(spark, tmp_path):
    assert folds.Runs(spark, str(tmp_path / "none"), folds._net).read() is None
