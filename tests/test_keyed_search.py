"""Tables stored by key join without an exchange; indexed search equals a scan."""

import random

import pytest
from pyspark.sql import functions as F

from stockflow.operators import stock, summaries
from stockflow.operators.trigram import build_index, candidates, search_index
from stockflow.plans.catalog import model
from stockflow.sources.keyed import buckets_for, read_keyed, write_keyed
from tests.conftest import SF_SMALL


def test_keyed_tables_reopen_as_stored(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 37).alias("k"), F.col("id").cast("decimal(14,3)").alias("q"), F.array("id").alias("a b"))
    kept = write_keyed(df, f"{tmp_path}/t", "k", 6)
    again = read_keyed(spark, f"{tmp_path}/t")
    assert again.schema == kept.schema and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert "Exchange" not in again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    write_keyed(df.limit(3), f"{tmp_path}/t", "k", 6)  # replaced
    assert read_keyed(spark, f"{tmp_path}/t").count() == 3
    assert buckets_for(spark, 10 << 30, 1 << 30) >= 10


def test_order_summary_over_keyed_tables_has_no_exchange_on_the_order(spark, tmp_path):
    m = model(spark, SF_SMALL)
    orders = write_keyed(m.sales_order, f"{tmp_path}/o", "id", 4)
    lines = write_keyed(m.sales_line, f"{tmp_path}/l", "order_id", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where no side is small
    try:
        pos = stock.stock_position(m.product, stock.reserved_sales(orders, lines))
        df = summaries.sales_order_summary(orders, lines, m.product, m.app_user, pos, keyed=True)
        plain = summaries.sales_order_summary(m.sales_order, m.sales_line, m.product, m.app_user, pos)
        assert sorted(map(str, df.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin [id#" in final
    assert "hashpartitioning(id#" not in final and "hashpartitioning(order_id#" not in final


def test_indexed_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["Anvil", "anVIL", "Öl", "öl kanne", "x", "", None, "aaa", "aaaa", "ab", "100% sure", "tail\\slash", "日本語テキスト", "ÉCLAIR éclair"]
    rows = [(i, rng.choice(words), " ".join(str(w) for w in rng.sample(words, 3)) if rng.random() < 0.8 else None) for i in range(400)] + [(7, "twice", "anvil")]
    df = spark.createDataFrame(rows, "id long, name string, note string")
    build_index(df, "id", ["name", "note"], str(tmp_path))
    for term in ["anvil", "ANVIL", "aaa", "aaaa", "aaaaa", "öl", "Ö", "x", "ab", "100%", "\\", "éclair é", "語テキ", "nothing like it", "", " ", "l k", "twice"]:
        want = sorted((i, str(a), str(b)) for i, a, b in rows if term == "" or any(f is not None and term.lower() in f.lower() for f in (a, b)))
        assert sorted((r.id, str(r.name), str(r.note)) for r in search_index(df, str(tmp_path), "id", ["name", "note"], term).collect()) == want, term


def test_only_the_rarest_lists_are_read_and_few_candidates_are_left(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("common words and number "), F.col("id").cast("string")).alias("name"))
    build_index(df, "id", ["name"], str(tmp_path))
    assert candidates(spark, str(tmp_path), "number 2718").count() <= 3
    assert [r.id for r in search_index(df, str(tmp_path), "id", ["name"], "number 2718").collect()] == [2718]
    assert candidates(spark, str(tmp_path), "common words").count() == 3000


@pytest.mark.parametrize("term", ["a", "abc", ""])
def test_empty_table(spark, tmp_path, term):
    df = spark.createDataFrame([], "id long, name string")
    build_index(df, "id", ["name"], str(tmp_path))
    assert search_index(df, str(tmp_path), "id", ["name"], term).count() == 0
