"""Guarded statuses against a plain replay, over several levels of chunks."""

import random

import pytest

from stockflow.operators import machine as M
from stockflow.operators.search import ORDER_STATUSES, allowed_commands

LEADS = {"confirm": "Confirmed", "start": "In Progress", "produce": "Done", "cancel": "Cancelled"}


def replay(orders, commands, kind):
    state = {i: s or "Draft" for i, s in orders}
    offered = set(allowed_commands(kind))
    out = []
    for o, seq, command, led in sorted((c for c in commands if c[0] is not None), key=lambda c: c[1]):
        old = state.get(o, "Draft")
        new = led or LEADS.get(command)
        fits = (old, command) in offered or (old not in ORDER_STATUSES[kind] and command == "cancel")
        accepted = fits and new in ORDER_STATUSES[kind]
        state[o] = new if accepted else old
        out.append((o, seq, old, state[o], accepted))
    return sorted(out, key=str), state


@pytest.mark.parametrize("kind,verb,word", [("sales", "deliver", "Delivered"), ("purchase", "receive", "Received"), ("manufacturing", "start", None)])
def test_equals_replay_with_a_hot_order_and_deep_chunks(spark, monkeypatch, kind, verb, word):
    monkeypatch.setattr(M, "CHUNK", 4)  # 200 commands of one order: more than three levels deep
    rng = random.Random(kind)
    commands = []
    for seq in range(500):
        o = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 40)])
        c = rng.choices(["confirm", verb, "produce", "cancel", "unheard of"], [4, 9, 1, 0.3, 1])[0]
        led = rng.choice([f"Partially {word}", f"Partially {word}", f"Fully {word}", "nowhere"]) if c == verb and word else None
        commands.append((o, seq, c, led))
    orders = [(i, rng.choice([None, "Draft", "Confirmed", "Cancelled", "Archived"])) for i in range(1, 30)]
    orders[0] = (1, "Draft")
    o_df = spark.createDataFrame(orders, "id long, status string")
    rows = M.guarded_statuses(o_df, spark.createDataFrame(commands, "order_id long, seq long, command string, status string"), kind)
    want, state = replay(orders, commands, kind)
    got = [(r.order_id, r.seq, r.old_status, r.new_status, r.accepted) for r in rows.collect()]
    assert sorted(got, key=str) == want
    assert any(r[4] for r in want) and any(not r[4] for r in want)
    final = {r.order_id: (r.status, r.accepted + r.refused) for r in M.final_guarded_status(o_df, rows).collect()}
    assert final == {i: (state[i], sum(c[0] == i for c in commands)) for i, _ in orders}


def test_no_commands(spark):
    orders = spark.createDataFrame([(1, None)], "id long, status string")
    none = spark.createDataFrame([], "order_id long, seq long, command string")
    rows = M.guarded_statuses(orders, none, "sales")
    assert rows.collect() == []
    assert [tuple(r) for r in M.final_guarded_status(orders, rows).collect()] == [(1, "Draft", 0, 0)]
