"""Deletes with refusal against a plain fixpoint; supply on all levels against
a plain plan, cycles included."""

import random

import pytest
from pyspark.sql import functions as F

from stockflow.operators import deletes
from stockflow.operators.deletes import delete_outcomes
from stockflow.operators.reach import reached
from stockflow.operators.supply import supply_components, supply_plan

CASCADE = [("lines", "order_id", "orders"), ("notes", "line_id", "lines")]
KEYS = CASCADE + [("orders", "user_id", "users"), ("lines", "product_id", "products"), ("products", "kit_id", "kits"),
                  ("kits", "product_id", "products"), ("users", "boss_id", "users"), ("gone", "x", "users"), ("users", "missing", "kits")]
COLUMNS = {"users": "boss_id", "orders": "user_id", "lines": "order_id product_id", "notes": "line_id", "products": "kit_id", "kits": "product_id"}


def plain(tables, requests):
    """Every request is tried with all others; what has to stay is found by
    marking until nothing changes."""
    rows = {(t, r["id"]): r for t, rs in tables.items() for r in rs}
    asked = {(t, i) for t, ids in requests.items() for i in ids if (t, i) in rows}
    going = set(asked)
    while True:
        more = {n for n, r in rows.items() for c, col, p in CASCADE if n[0] == c and (p, r[col]) in going} - going
        if not more:
            break
        going |= more
    restrict = [k for k in KEYS if k not in CASCADE and k[0] in tables and k[1] in COLUMNS[k[0]].split()]
    stays = set()
    while True:
        new = set()
        for n, r in rows.items():
            for c, col, p in restrict:
                if n[0] == c and r[col] is not None and (p, r[col]) in going and (n not in going or n in stays):
                    new.add((p, r[col]))
            for c, col, p in CASCADE:
                up = (p, r[col]) if n[0] == c else None
                if up in going and n in going:
                    if n in stays:
                        new.add(up)
                    if up in stays and n not in asked:
                        new.add(n)
        if new <= stays:
            break
        stays |= new
    out = {}
    for n in going:
        blocks = [f"{c}.{col}" for m, r in rows.items() for c, col, p in restrict if m[0] == c and (p, r[col]) == n and (m not in going or m in stays)]
        state = ("refused" if n in asked else "kept") if n in stays else ("deleted" if n in asked else "cascaded")
        out[(n[0], str(n[1]))] = (state, min(blocks, default=None))
    return out


def database(seed, share):
    rng = random.Random(seed)
    sizes = {"users": 8, "orders": 25, "lines": 50, "notes": 30, "products": 12, "kits": 8}
    tables = {t: [{"id": i} | {c: None for c in COLUMNS[t].split()} for i in range(n)] for t, n in sizes.items()}
    parent = {(c, col): p for c, col, p in KEYS}
    for t, rs in tables.items():
        for r in rs:
            for c in COLUMNS[t].split():
                if rng.random() < 0.8:
                    r[c] = 0 if rng.random() < 0.2 else rng.randrange(sizes[parent[(t, c)]] + 2)  # some point nowhere
    requests = {t: sorted(i for i in range(n + 2) if rng.random() < share) for t, n in sizes.items() if t != "notes"}
    return tables, requests


@pytest.mark.parametrize("seed,share", [(1, 0.95), (2, 0.8), (3, 0.4)])
def test_deletes_equal_the_plain_fixpoint(spark, seed, share):
    tables, requests = database(seed, share)
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rs], ", ".join(f"{c} long" for c in ["id", *COLUMNS[t].split()])) for t, rs in tables.items()}
    asked = {t: spark.createDataFrame([(i,) for i in ids for _ in (0, 1)], "id long") for t, ids in requests.items()}
    got = {(r.table_name, r.key): (r.outcome, r.blocked_by) for r in delete_outcomes(frames, asked, CASCADE, KEYS).collect()}
    want = plain(tables, requests)
    assert got == want
    assert len({o for o, _ in want.values()}) >= 3


def test_rows_that_refer_to_each_other_go_together(spark):
    tables = {"products": spark.createDataFrame([(1, 1), (2, 2)], "id long, kit_id long"),
              "kits": spark.createDataFrame([(1, 1), (2, 2)], "id long, product_id long")}
    asked = {"products": tables["products"].select("id"), "kits": tables["kits"].filter("id = 1").select("id")}
    got = {(r.table_name, r.key): (r.outcome, r.blocked_by) for r in delete_outcomes(tables, asked, [], KEYS).collect()}
    assert got == {("products", "1"): ("deleted", None), ("kits", "1"): ("deleted", None), ("products", "2"): ("refused", "kits.product_id")}


def test_reach_follows_cycles_once(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (50, 51)], "a long, b long")
    got = reached(spark.createDataFrame([(1,), (1,)], "a long"), edges, ["a"], ["b"])
    assert sorted(r.a for r in got.collect()) == list(range(1, 13))


def plain_supply(demand, products, parts):
    level, made = {}, {p for p, (_, on, kind, bom) in products.items() if on and kind == "Manufacturing" and bom in parts}
    below = lambda p: [c for c, _ in parts[products[p][3]]] if p in made else []

    def depth(p, path=()):
        if p in path:
            raise RecursionError
        level[p] = max(level.get(p, 0), len(path))
        for c in below(p):
            depth(c, (*path, p))

    for p in demand:
        depth(p)
    need, out = {}, {}
    for p in sorted(level, key=level.get):
        free, on, kind, bom = products.get(p, (0, False, None, None))
        net = demand.get(p, 0) + max(0, need.get(p, 0) - max(0, free))
        out[p] = (level[p], demand.get(p, 0), need.get(p, 0), net, kind if on and net > 0 else None)
        for c, q in parts[bom] if p in made else []:
            need[c] = need.get(c, 0) + net * q
    return out


def supply_frames(spark, demand, products, parts):
    qty = "decimal(14,3)"
    return (spark.createDataFrame([(p, q) for p, q in demand.items()], "product_id long, quantity long"),
            spark.createDataFrame([(p, f, on, kind, bom) for p, (f, on, kind, bom) in products.items()], "product_id long, free_qty long, procure_on_demand boolean, procurement_type string, bom_id long"),
            spark.createDataFrame([(b, c, q) for b, cs in parts.items() for c, q in cs], "bom_id long, component_product_id long, to_consume_qty long").withColumn("to_consume_qty", F.col("to_consume_qty").cast(qty)))


@pytest.mark.parametrize("seed", [4, 6])
def test_supply_equals_the_plain_plan(spark, seed):
    rng = random.Random(seed)
    n = 30
    products = {p: (rng.randrange(-5, 20), rng.random() < 0.85, rng.choice(["Manufacturing", "Manufacturing", "Purchase"]), p if rng.random() < 0.8 else None) for p in range(n)}
    parts = {p: [(rng.randrange(p + 1, min(n + 1, p + 9)), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))] for p in range(n - 1)}
    demand = {p: rng.randrange(1, 9) for p in rng.sample(range(8), 4)} | {77: 3}
    d, p, c = supply_frames(spark, demand, products, parts)
    plan, cycles = supply_plan(d, p, c)
    got = {r.product_id: (r.level, int(r.demand_qty), int(r.needed_qty), int(r.net_qty), r.supply) for r in plan.collect()}
    assert got == plain_supply(demand, products, parts) and cycles.count() == 0
    assert max(v[0] for v in got.values()) >= 3
    made = {(r.product_id, r.part_id) for r in supply_components(plan, p, c).collect()}
    assert made == {(q, x) for q, v in got.items() if v[4] == "Manufacturing" and products[q][3] in parts for x, _ in parts[products[q][3]]}


def test_cycles_are_reported_and_the_rest_is_planned(spark):
    products = {p: (0, True, "Manufacturing", p) for p in range(1, 8)}
    parts = {1: [(2, 1)], 2: [(3, 1)], 3: [(2, 1), (4, 1)], 5: [(6, 2)], 7: [(7, 1)]}
    plan, cycles = supply_plan(*supply_frames(spark, {1: 1, 5: 2, 7: 1}, products, parts))
    assert {r.product_id: int(r.net_qty) for r in plan.collect()} == {1: 1, 5: 2, 6: 4}
    assert sorted(r.product_id for r in cycles.collect()) == [2, 3, 4, 7]


def test_no_demand(spark):
    d, p, c = supply_frames(spark, {1: 1}, {1: (0, True, "Purchase", None)}, {1: [(2, 1)]})
    plan, cycles = supply_plan(d.limit(0), p, c)
    assert plan.count() == 0 and cycles.count() == 0


def test_tables_that_cannot_stay_take_no_part_in_the_rounds(spark, monkeypatch):
    """Nothing refers to the ledger: its going rows hold nothing, its others one row per product."""
    sizes = {}
    real = deletes.store

    def counted(df, tag):
        out = real(df, tag)
        sizes[tag] = sizes.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(deletes, "store", counted)
    tables = {"products": spark.createDataFrame([(i,) for i in range(5)], "id long"),
              "ledger": spark.createDataFrame([(i, i % 5) for i in range(200)] + [(None, 3), (7, 2), (7, 1)], "id long, product_id long")}
    asked = {"products": tables["products"], "ledger": tables["ledger"].filter("id >= 10 or id in (1, 7)")}
    got = {(r.table_name, r.key): (r.outcome, r.blocked_by)
           for r in deletes.delete_outcomes(tables, asked, [], [("ledger", "product_id", "products")]).collect()}
    held = {str(i) for i in range(5)}  # ids 0 to 9 but 1 and 7, and the row without an id, refer to all
    assert {k: v for (t, k), v in got.items() if t == "products"} == {k: ("refused", "ledger.product_id") for k in held}
    assert {k: v for (t, k), v in got.items() if t == "ledger"} == {str(i): ("deleted", None) for i in [1, 7, *range(10, 200)]}
    assert sizes["references"] == 5 and sizes["spread"] == 0


def test_tables_whose_rows_may_stay():
    restrict, cascade = [("a", "x", "b"), ("b", "y", "c")], [("d", "z", "b"), ("e", "z", "a"), ("f", "z", "e")]
    assert deletes.staying_tables(restrict, cascade) == {"b", "c", "d"}
    assert deletes.longest_path(cascade, ["a"]) == 2 and deletes.longest_path(cascade, ["c"]) == 0
    assert deletes.longest_path([("a", "up", "a")], ["a"]) is None
