"""Scans and numberings that split hot keys from small ones: the same results
however the rows are split, and one exchange where no key is hot."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockflow.operators import resume, summaries
from stockflow.operators.changes import number_within
from stockflow.operators.scan import prefix_scans, scan_carry, split_hot
from stockflow.operators.trigram import _postings, build_index, search_index
from stockflow.sources import model
from stockflow.sources.tables import RAW_SCHEMAS

SPECS = [("v", "sum", "total"), ("v", "max", "most"), ("v", "min", "least"), ("s", "last", "latest")]
HOT = [1, 40, 1_000_000]  # all keys hot, one, none


def _rows(spark, seed):
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])), i, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, f"s{i}"]))
            for i in range(200)]
    return spark.createDataFrame(rows, "k string, seq long, v long, s string")


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("hot_rows", HOT)
@pytest.mark.parametrize("inclusive", [True, False])
def test_split_scan_equals_pieces(spark, hot_rows, inclusive):
    df = _rows(spark, 5)
    first, second = df.filter("seq < 90"), df.filter("seq >= 90")
    carry = scan_carry(first, ["k"], ["seq"], SPECS).checkpoint()
    for part, state in ((df, None), (second, carry)):
        want = prefix_scans(part, ["k"], ["seq"], SPECS, inclusive, carry=state)
        for sizes in (None, part):
            got = prefix_scans(part, ["k"], ["seq"], SPECS, inclusive, carry=state, settle=True, sizes=sizes, hot_rows=hot_rows)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_split_keeps_keys_whole(spark):
    df = _rows(spark, 6)
    small, hot = split_hot(df, ["k"], df, 60)
    assert {r.k for r in hot.select("k").distinct().collect()} & {r.k for r in small.select("k").distinct().collect()} == set()
    assert small.count() + hot.count() == 200 and hot.filter("k = 'hot'").count() == df.filter("k = 'hot'").count()


def test_small_keys_take_one_exchange(spark):
    df = _rows(spark, 7)
    text = _final_plan(prefix_scans(df, ["k"], ["seq"], SPECS, settle=True))
    assert text.count("Exchange") == 1 and "pieces" not in text
    text = _final_plan(number_within(df, ["k"], ["seq"]))
    assert text.count("Exchange") == 1 and "positions" not in text


@pytest.mark.parametrize("hot_rows", HOT)
def test_number_within_of_hot_and_small_keys(spark, hot_rows):
    df = _rows(spark, 8)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("bigint"))
    got = number_within(df, ["k"], ["seq"], "n", hot_rows=hot_rows)
    assert got.columns == want.columns and got.schema["n"].dataType == want.schema["n"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ledger_batch_leads_with_the_state(spark):
    """Balances of a batch without pieces: one exchange for the rows."""
    moves = spark.createDataFrame([(1, 1, 5), (1, 2, -2), (2, 1, 4), (None, 1, 3)], "product_id long, t long, movement_qty long")
    state = resume.opening_state(spark.createDataFrame([(1, 10), (None, 1)], "product_id long, on_hand_qty long"), moves, ["t"])
    done = resume.ledger_batch(moves, state, ["t"])
    got = sorted(((r.product_id, r.t, int(r.resulting_on_hand)) for r in done.rows.collect()), key=str)
    assert got == sorted([(1, 1, 15), (1, 2, 13), (2, 1, 4), (None, 1, 4)], key=str)
    assert _final_plan(done.rows).count("Exchange") == 1


def test_nested_children_are_read_once(spark, tmp_path):
    """Headers without children get their empty array without another pass over the children."""
    rows = [(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (4, 1, "d"), (None, 1, "e")]
    spark.createDataFrame(rows, "o long, line_seq long, x string").write.parquet(f"{tmp_path}/childrows")
    headers = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    out = summaries.attach_children(headers, "id", spark.read.parquet(f"{tmp_path}/childrows"), "o", "lines", ["line_seq", "x"], False)
    got = sorted(((r.id, r.chunk_no, [tuple(x) for x in r.lines]) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, [(1, "a"), (2, "b")]), (2, 0, []), (3, 0, []), (None, 0, [])], key=str)
    assert "childrows" not in _final_plan(out)


def test_records_move_before_they_are_cut_into_grams(spark, tmp_path):
    """Postings follow the only exchange; equal records count once, and records of one key that share grams are found."""
    df = spark.createDataFrame([(1, "abcd", "x"), (1, "abcd", "x"), (1, "abce", None), (2, "zabc", "abcd")], "id long, name string, note string")
    text = _final_plan(_postings(df, "id", ["name", "note"]))
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")
    build_index(df, "id", ["name", "note"], str(tmp_path))
    for term, want in (("abcd", [1, 1, 2]), ("abce", [1]), ("zab", [2]), ("x", [1, 1])):
        assert sorted(r.id for r in search_index(df, str(tmp_path), "id", ["name", "note"], term).collect()) == want, term


def test_a_state_with_repeated_keys_fails(spark):
    df = _rows(spark, 9)
    carry = scan_carry(df, ["k"], ["seq"], SPECS)
    with pytest.raises(Exception, match="several rows of one key"):
        prefix_scans(df, ["k"], ["seq"], SPECS, carry=carry.unionByName(carry), settle=True).collect()


def test_numbering_does_not_move_its_tie_hash(spark):
    """the hash that settles ties is taken after the exchange of the rows."""
    text = _final_plan(number_within(_rows(spark, 9), ["k"], ["seq"]))
    assert text.index("xxhash64") < text.index("Exchange") < text.index("Scan")


def _sales(spark):
    orders = spark.createDataFrame([(1, "Confirmed", 7), (2, "Draft", None), (3, "Confirmed", 7)], "id long, status string, sales_person_id long")
    lines = spark.createDataFrame([(1, 1, 10, 5, 0), (1, 2, 11, 1, 2), (1, None, 10, 1, 0), (3, 1, None, 4, 0), (9, 1, 10, 1, 0)],
                                  "order_id long, line_seq long, product_id long, ordered_qty long, done_qty long").withColumns(
                                      {c: F.col(c).cast("decimal(14,3)") for c in ("ordered_qty", "done_qty")})
    products = spark.createDataFrame([(10, "desk", 2), (11, "lamp", 3)], "product_id long, product_name string, sales_price long").withColumn("sales_price", F.col("sales_price").cast("decimal(12,2)"))
    position = spark.createDataFrame([(10, 6, 2), (11, 6, 2)], "product_id long, on_hand_qty long, reserved_qty long").withColumns(
        {c: F.col(c).cast("decimal(20,3)") for c in ("on_hand_qty", "reserved_qty")})
    users = spark.createDataFrame([(7, "Ann")], "id long, name string")
    return orders, lines, products, users, position


@pytest.mark.parametrize("keyed", [False, True])
def test_flat_sales_summary_of_odd_lines(spark, keyed):
    """Headers without lines have no availability; lines without a number or a product have one."""
    df = summaries.sales_order_summary(*_sales(spark), keyed=keyed)
    got = {(r.id, r.line_seq, r.product_name, r.availability, r.sales_person_name, r.total and int(r.total)) for r in df.collect()}
    assert got == {(1, 1, "desk", "Shortage", "Ann", 10), (1, 2, "lamp", "Available", "Ann", 6), (1, None, "desk", "Available", "Ann", 2),
                   (2, None, None, None, None, None), (3, 1, None, "Available", "Ann", None)}


def test_flat_sales_summary_does_not_move_names_by_order(spark):
    """lines meet their order first; rows with their product's columns are not moved again."""
    orders, lines, products, users, position = _sales(spark)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = _final_plan(summaries.sales_order_summary(orders, lines, products, F.broadcast(users), position))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert keys[0] == "product_id" and keys.count("id") == 2


@pytest.mark.parametrize("hot", [False, True])
def test_lines_are_stored_by_order_unless_one_is_hot(spark, tmp_path, monkeypatch, hot):
    """lines are dealt by order once, to be numbered; joins and groups on the order need no exchange."""
    rng = random.Random(10)
    day = datetime.datetime(1997, 1, 1)
    rows = [(rng.choice([1, 2, 3, 40, None]), rng.randrange(5), 1, rng.randrange(3), rng.choice([2.0, 3.0, None]), float(i), 0.0, 0.0, rng.choice("ANR"), rng.choice("FO"), day)
            for i in range(90)]
    raw = spark.createDataFrame(rows, RAW_SCHEMAS["lineitem"])
    raw.write.parquet(f"{tmp_path}/lineitem.parquet")
    if hot:
        monkeypatch.setattr(model, "hot_groups", lambda *a: [0])
    line = model.Model(spark, str(tmp_path)).line
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    want = raw.withColumn("n", F.row_number().over(w)).select("l_orderkey", "n", "l_partkey", "l_returnflag")
    assert sorted(map(str, map(tuple, line.select("order_id", "line_seq", "product_id", "l_returnflag").collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert ("Exchange" in _final_plan(line.groupBy("order_id").count())) == hot
    assert model.Model(spark, str(tmp_path), materialize=False).line.columns == line.columns
