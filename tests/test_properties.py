"""Property tests: the set-based operators against plain Python loops that
replay the reference's sequential semantics, with a hot key and several
partition counts."""

import math
import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockflow.operators import changes, fulfil
from stockflow.operators.scan import prefix_scan


def _rows(seed, n_keys=12, n=400, hot_share=0.35):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot_share else (None if rnd.random() < 0.05 else rnd.randrange(1, n_keys))
        v = None if rnd.random() < 0.1 else rnd.randint(-20, 50)
        rows.append((k, i * 3 + rnd.randrange(3), v))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("op", ["sum", "max", "min", "last"])
@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_scan_equals_loop(spark, op, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "k int, seq long, v int").repartition(5)
    expect = {}
    for inclusive in (True, False):
        state = {}
        for k, s, v in sorted(rows, key=lambda r: r[1]):
            cur = state.get(k)
            before = cur
            if v is not None:
                if op == "sum":
                    cur = v if cur is None else cur + v
                elif op == "max":
                    cur = v if cur is None else max(cur, v)
                elif op == "min":
                    cur = v if cur is None else min(cur, v)
                else:
                    cur = v
            state[k] = cur
            expect[(inclusive, s)] = cur if inclusive else before
        for parts in (1, 9):
            out = prefix_scan(df, ["k"], ["seq"], "v", op, "out", inclusive=inclusive, num_partitions=parts)
            got = {r.seq: r.out for r in out.collect()}
            assert got == {s: expect[(inclusive, s)] for _, s, _ in rows}, (op, inclusive, parts)


def _js_deliver(ordered, initial, requests, fallback=False):
    d = initial or 0
    out = []
    for x in requests:
        falsy = x is None or (isinstance(x, float) and math.isnan(x)) or x == 0
        r = (ordered if fallback else 0) if falsy else x
        delta = min(r, ordered) - d
        if delta > 0:
            d += delta
            out.append(delta)
        else:
            out.append(0)
    return out


@pytest.mark.parametrize("seed,fallback", [(3, False), (4, False), (5, True), (6, True)])
def test_running_max_equals_reference_loop(spark, seed, fallback):
    rnd = random.Random(seed)
    rows, expect = [], {}
    seq = 0
    for line in range(40):
        ordered = rnd.randint(1, 20)
        initial = rnd.choice([None, 0, rnd.randint(0, 25)])
        reqs = [rnd.choice([None, math.nan, -3, 0, rnd.randint(0, 30), ordered + 5]) for _ in range(12)]
        for r, d in zip(reqs, _js_deliver(ordered, initial, reqs, fallback)):
            rows.append((line, seq, float(r) if r is not None else None, float(ordered),
                         float(initial) if initial is not None else None))
            expect[seq] = d
            seq += 1
    df = spark.createDataFrame(rows, "line_id int, seq long, requested_qty double, ordered_qty double, done_qty double")
    got = {r.seq: float(r.delta) for r in
           fulfil.apply_quantity_commands(df.repartition(3), ["line_id"], ["seq"], fallback_to_need=fallback).collect()}
    assert got == {k: float(v) for k, v in expect.items()}


def _replay(feed):
    state, rejects = {}, set()
    for key, seq, op, v, label in sorted(feed, key=lambda r: r[1]):
        if op == "create":
            state[key] = {"v": v, "label": label, "seq": seq}
        elif key not in state:
            rejects.add(seq)
        elif op == "delete":
            del state[key]
        else:
            if v is not None:
                state[key]["v"] = v
            state[key]["label"] = label
            state[key]["seq"] = seq
    return state, rejects


@pytest.mark.parametrize("seed", [6, 7])
def test_compact_changes_equals_replay(spark, seed):
    rnd = random.Random(seed)
    feed = []
    for seq in range(500):
        key = 0 if rnd.random() < 0.3 else rnd.randrange(1, 25)
        op = rnd.choices(["create", "update", "delete"], [2, 6, 1])[0]
        v = None if rnd.random() < 0.3 else rnd.randint(0, 100)
        label = None if rnd.random() < 0.2 else f"l{seq}"
        feed.append((key, seq, op, v, label))
    df = spark.createDataFrame(feed, "k int, seq long, op string, v int, label string").repartition(4)
    state, rejects = _replay(feed)
    got = {r.k: {"v": r.v, "label": r.label, "seq": r.last_seq}
           for r in changes.compact_changes(df, "k", keep_cols=["v"], overlay_cols=["label"]).collect()}
    assert got == state
    assert {r.seq for r in changes.feed_rejects(df, "k").collect()} == rejects


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_assign_references_global_order(spark, parts):
    rnd = random.Random(parts)
    base = dt.date(2020, 1, 1)
    rows = [(i, base + dt.timedelta(days=rnd.randrange(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, d date")
    out = changes.assign_references(df, "PO", 10, ["d", "id"], num_partitions=parts)
    got = {r.id: (r.new_id, r.reference) for r in out.collect()}
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: (10 + i, f"PO-{11 + i:06d}") for i, r in enumerate(ranked)}


def test_hot_key_is_spread_over_tasks(spark):
    """A key with a third of the rows, all but one of them tied on the first
    order value and one far away: its rows spread evenly over the pieces, and
    the running sum still goes up by one per row."""
    from pyspark.sql import Window

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
            F.when(F.col("id") == 0, F.lit(10 ** 9)).otherwise(F.lit(5)).alias("day"), "id", F.lit(1).alias("v"))
        out = prefix_scan(df, ["k"], ["day"], "v", "sum", "run")
        got = out.filter("k = 0").select(F.spark_partition_id().alias("p"), "run", "id").collect()
        assert sorted(r.run for r in got) == list(range(1, 10001))
        assert next(r.run for r in got if r.id == 0) == 10000
        sizes = sorted(n for n in (sum(r.p == p for r in got) for p in {r.p for r in got}))
        assert len(sizes) >= 3 and sizes[-1] <= 6000
        plain = df.select(F.count("*").over(Window.partitionBy("k")).alias("n"), "k").filter("k = 0")
        assert len({r.p for r in plain.select(F.spark_partition_id().alias("p"), "n").collect()}) == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_prefix_scan_runs_no_job_when_built(spark):
    """Building the plan starts no job, and both sides read one exchange."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "build")
    out = prefix_scan(spark.range(100).withColumn("v", F.lit(1)), [], ["id"], "v", "sum", "run")
    assert tracker.getJobIdsForGroup("build-only") == []
    spark.sparkContext.setJobGroup("run", "run")
    assert sorted(r.run for r in out.select("run").collect()) == list(range(1, 101))


def test_last_request_status_equals_final_status(spark):
    """The per-request status (prefix sum of completions) after an order's
    last request equals D13 on its final line state."""
    from pyspark.sql import Window
    from stockflow.sources.model import Model, deliver_command
    m = Model(spark, "/root/testdata/sf0.001")
    out = fulfil.fulfil_sales(m.sales_order, m.sales_line, deliver_command(m), ["cmd_time"])
    w = Window.partitionBy("order_id").orderBy(F.col("cmd_time").desc())
    last = (out["audit"].withColumn("r", F.row_number().over(w)).filter("r = 1")
            .select("order_id", F.col("new_value").alias("status")))
    a = {(r.order_id, r.status) for r in last.collect()}
    b = {(r.order_id, r.status) for r in out["status"].collect()}
    assert a == b and len(a) > 0


def test_request_status_small(spark):
    lines = spark.createDataFrame([(1, 1, 7, 5.0, 0.0), (1, 2, 8, 3.0, 3.0), (1, 3, 9, 4.0, 1.0)],
                                  "order_id int, line_seq int, product_id int, ordered_qty double, done_qty double")
    cmds = spark.createDataFrame([(1, 1, 2.0, 10), (1, 3, 4.0, 10), (1, 1, 5.0, 20)],
                                 "order_id int, line_seq int, requested_qty double, t int")
    out = fulfil.fulfil_sales(spark.createDataFrame([(1,)], "id int"), lines, cmds, ["t"])
    got = sorted((r.t, r.new_value) for r in out["audit"].collect())
    assert got == [(10, "Partially Delivered"), (20, "Fully Delivered")]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_number_within_equals_row_number(spark, parts):
    from pyspark.sql import Window
    from stockflow.operators.changes import number_within
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 5 < 3, F.lit(1)).otherwise(F.col("id") % 11)
        .alias("k"), ((F.col("id") * 7919) % 5003).alias("o"))
    expect = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    got = number_within(df, ["k"], ["o"], "rn", num_partitions=parts)
    assert got.select("k", "o", "rn").exceptAll(expect.select("k", "o", "rn")).count() == 0
    assert got.count() == 5000
