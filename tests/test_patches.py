"""Edits with any keys: JSON types live on, absent, null and value stay apart."""

import json

from pyspark.sql import functions as F

from stockflow.operators import patches as P

PATCH = "id long, seq long, body string"


def overlay(spark, base, sent, **kw):
    df = P.overlay_documents(base, spark.createDataFrame(sent, PATCH), "id", **kw)
    return {r["id"]: {c: (json.loads(r[c]) if c == "extra" and r[c] else r[c]) for c in df.columns if c != "id"} for r in df.withColumn("extra", F.to_json("extra")).collect()}


def test_last_value_per_key_and_record(spark):
    base = spark.createDataFrame([(1, "R1", 5.0, True), (2, "R2", 6.0, None), (3, "R3", 7.0, False)], "id long, reference string, price double, active boolean")
    sent = [(1, 1, '{"price": 9.5, "colour": "red", "tags": ["a", 1, null], "reference": "no", "id": 99}'),
            (1, 2, '{"colour": "blue", "size": {"h": 1.25}, "active": null}'), (1, 3, '{"size": null}'),
            (2, 1, '{"price": "not a price", "active": true, "deep": {"price": 1}}'), (2, 0, '{"price": 1, "old": false}'),
            (9, 1, '{"price": 1}')]
    got = overlay(spark, base, sent)
    assert got[1] == {"reference": "R1", "price": 9.5, "active": None, "extra": {"colour": "blue", "size": None, "tags": ["a", 1, None]}}
    assert got[2] == {"reference": "R2", "price": None, "active": True, "extra": {"deep": {"price": 1}, "old": False, "price": "not a price"}}
    assert got[3] == {"reference": "R3", "price": 7.0, "active": False, "extra": None}
    assert set(got) == {1, 2, 3}


def test_documents_overlaid_again_keep_what_they_had(spark):
    base = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, price double")
    first = P.overlay_documents(base, spark.createDataFrame([(1, 1, '{"a": 1, "b": "x"}'), (2, 1, '{"a": 2}')], PATCH), "id")
    assert overlay(spark, first, [(1, 2, '{"b": null, "c": [true]}')]) == {
        1: {"price": 5.0, "extra": {"a": 1, "b": None, "c": [True]}}, 2: {"price": 6.0, "extra": {"a": 2}}}


def test_types_of_values(spark):
    sent = spark.createDataFrame([(1, 1, '{"n": 1, "d": 2.5, "s": "1", "t": true, "z": null, "o": {}, "l": []}')], PATCH)
    rows = P.patch_fields(sent, "id").select("field", P.json_type(F.col("value")).alias("kind")).collect()
    assert {r.field: r.kind for r in rows} == {"n": "number", "d": "number", "s": "string", "t": "boolean", "z": "null", "o": "object", "l": "array"}


def test_bodies_that_change_nothing(spark):
    base = spark.createDataFrame([(1, 5.0)], "id long, price double")
    sent = [(1, 1, "[1, 2]"), (1, 2, "{broken"), (1, 3, None), (1, 4, "7"), (5, 5, "{}"), (1, 6, "{}"), (None, 7, '{"price": 1}')]
    assert overlay(spark, base, sent) == {1: {"price": 5.0, "extra": None}}
    rejects = P.document_rejects(base, spark.createDataFrame(sent, PATCH), "id")
    assert sorted((r.seq, r.error) for r in rejects.collect()) == [(1, "not an object"), (2, "not an object"), (3, "not an object"), (4, "not an object"), (5, "not found"), (7, "not found")]


def test_forms_become_bodies(spark):
    fields = {"qty": "12", "price": "1e3", "due_date": "2024", "email": "5", "note": 'a "q" \\ <é>', "empty": "", "yes": "true", "far": "Infinity", "hex": "0x1F"}
    df = spark.createDataFrame([(fields,)], "fields map<string,string>").select(F.to_json(P.form_body(F.col("fields"))).alias("body"))
    assert json.loads(df.first()[0]) == {"qty": 12, "price": 1000, "due_date": "2024", "email": "5", "note": fields["note"], "empty": None, "yes": True, "far": None, "hex": 31}


def test_a_hot_record_with_many_edits(spark):
    base = spark.createDataFrame([(i, 0.0) for i in range(3)], "id long, price double")
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3).cast("long").alias("id"), F.col("id").alias("seq"),
                                      F.concat(F.lit('{"price":'), F.col("id").cast("string"), F.lit(',"k'), (F.col("id") % 50).cast("string"), F.lit('":1}')).alias("body"))
    got = P.overlay_documents(base, rows, "id").select("price", F.size(F.variant_get("extra", "$", "map<string,variant>")).alias("n")).collect()
    assert sorted((r.price, r.n) for r in got) == [(19_997.0, 50), (19_998.0, 50), (19_999.0, 50)]
