"""G1-G13 edge behaviour."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockflow.functions import scalars as S


def one(spark, expr, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first().r


def test_clean_text(spark):
    assert one(spark, S.clean_text("x"), row=("  a <b>\tc  d\n ",)) == "a b c d"
    assert one(spark, S.clean_text("x", 3), row=("abcdef",)) == "abc"
    assert one(spark, S.clean_text("x")) == ""


def test_date_only(spark):
    assert one(spark, S.date_only("x"), row=("2024-05-06T10:00:00Z",)) == "2024-05-06"
    assert one(spark, S.date_only("x"), row=("",)) == ""
    assert one(spark, S.date_only("x")) == ""


def test_or_default_by_kind(spark):
    assert one(spark, S.or_default("x", 7), "x double", (0.0,)) == 7
    assert one(spark, S.or_default("x", 7), "x double", (float("nan"),)) == 7
    assert one(spark, S.or_default("x", 7), "x double", (2.5,)) == 2.5
    assert one(spark, S.or_default("x", "d", "text"), row=("",)) == "d"
    assert one(spark, S.or_default("x", "d", "text"), row=("0",)) == "0"
    assert one(spark, S.or_default("x", True, "bool"), "x boolean", (False,)) is True


def test_clamps_skip_nulls(spark):
    assert one(spark, S.at_least("x", 0), "x int", (-3,)) == 0
    assert one(spark, S.at_least("x", 0), "x int", (None,)) == 0
    assert one(spark, S.at_most("x", 10), "x int", (12,)) == 10


def test_contains_null_is_false(spark):
    assert one(spark, S.contains_ci("x", "AB")) is False
    assert one(spark, S.contains_ci("x", "AB"), row=("xaby",)) is True
    assert one(spark, S.contains("x", "AB"), row=("xaby",)) is False


def test_availability_modes(spark):
    schema = "o decimal(14,3), h decimal(14,3), r decimal(14,3)"
    row = (D(5), D(10), D(6))
    assert one(spark, S.availability("o", "h", "r", "sales"), schema, row) == "Shortage"
    assert one(spark, S.availability("o", "h", "r", "mo"), schema, row) == "Not Available"
    assert one(spark, S.availability("o", "h", "r", "snapshot"), schema, (D(4), D(10), D(6))) == "Available"
    assert one(spark, S.availability("o", "h", "r", "sales"), schema, (D(5), None, D(6))) == "Available"


def test_reference_code_and_email(spark):
    assert one(spark, S.reference_code("PO", F.col("x")), "x long", (42,)) == "PO-000042"
    assert one(spark, S.norm_email("x"), row=("  Ann@Example.TEST ",)) == "ann@example.test"
    assert one(spark, S.add_days("2024-02-28", 2), "x int", (1,)).isoformat() == "2024-03-01"


def test_exact_sum_matches_decimal_sum(spark):
    df = spark.createDataFrame([(D("1.125"),), (D("-2.500"),), (None,), (D("1000000.001"),)], "q decimal(14,3)")
    r = df.agg(S.exact_sum("q", 3, "decimal(20,3)").alias("a"), F.sum("q").alias("b")).first()
    assert r.a == r.b == D("999998.626")


def test_exact_sum_cuts_nothing(spark):
    fine = spark.createDataFrame([(D("1.000490"),), (D("1.000490"),)], "q decimal(20,6)")
    assert fine.agg(S.exact_sum("q", 3, "decimal(20,3)").alias("s")).first().s == D("2.001")
    doubles = spark.createDataFrame([(0.29,), (0.29,)], "q double")
    assert doubles.agg(S.exact_sum("q", 2).alias("s")).first().s == D("0.58")
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            big = spark.createDataFrame([(D("9000000000000000.001"),)] * 3, "q decimal(19,3)")
            assert big.agg(S.exact_sum("q", 3, "decimal(23,3)").alias("s")).first().s == D("27000000000000000.003")
            with pytest.raises(Exception, match="does not fit"):
                spark.createDataFrame([(1e-12,)], "q double").agg(S.exact_sum("q")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_opening_comes_first_whatever_the_order_value(spark):
    from stockflow.operators.ledger import ledger

    moves = spark.createDataFrame([(1, D("5.000"), None), (1, D("2.000"), 3)], "product_id int, movement_qty decimal(14,3), seq int")
    opening = spark.createDataFrame([(1, D("100.000"))], "product_id int, on_hand_qty decimal(14,3)")
    got = {r.seq: r.resulting_on_hand for r in ledger(moves, opening, ["seq"]).collect()}
    assert got == {None: D("105.000"), 3: D("107.000")}
