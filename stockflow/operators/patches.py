"""Free-form edits (E7a, G3): patch bodies with any keys, as VARIANT.

A patch is a JSON object. Its keys are taken apart as rows of VARIANT, the last
value per record and key wins, and types are decided late: a key that is a
column of the record is read as that column's type, all other keys live on
with their JSON types in one VARIANT column. A key that was never sent, one
sent as null and one sent with a value stay three different things.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.scalars import coerce_value


def _text(value: Column) -> Column:
    """A string as a JSON string literal."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def form_body(fields: Column) -> Column:
    """A form's map of texts as a patch body: '' becomes null, 'true' and
    'false' booleans, numeric texts numbers (but not under keys with 'date',
    nor password and email), other texts stay. Numbers that JSON can't hold
    (infinite ones) become null."""
    def literal(e: Column) -> Column:
        v = coerce_value(e["key"], e["value"])
        number = F.when(F.abs(v["number"]) < F.lit(float("inf")), v["number"].cast("string")).otherwise("null")
        return (F.when(v["kind"] == "text", _text(v["text"])).when(v["kind"] == "boolean", v["flag"].cast("string"))
                 .when(v["kind"] == "number", number).otherwise("null"))

    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(_text(e["key"]), F.lit(":"), literal(e)))
    return F.parse_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def _body(patches: DataFrame, body: str) -> Column:
    return F.col(body) if isinstance(patches.schema[body].dataType, T.VariantType) else F.try_parse_json(body)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_type(v: Column) -> Column:
    """null, boolean, number, string, object or array; SQL null for no value."""
    s = F.schema_of_variant(v)
    return (F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string")
             .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.isNotNull(), "number"))


def patch_fields(patches: DataFrame, key: str, body: str = "body", order: str = "seq",
                 protected: Sequence[str] = ("reference",)) -> DataFrame:
    """(key, field, value VARIANT, order): the last value sent per record and
    field, a sent null included. The key itself and protected fields are not
    changed by patches. Bodies that are no JSON objects have no fields."""
    rows = patches.select(F.col(key), F.col(order), _body(patches, body).alias("_v")).filter(_is_object(F.col("_v")))
    sent = (rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
            .filter(~F.col("key").isin(key, *protected))
            .select(F.col(key).alias("_id"), F.col("key").alias("field"), "value", F.col(order).alias("_order")))
    return (sent.groupBy("_id", "field").agg(F.max_by(F.struct("value", "_order"), "_order").alias("_last"))
            .select(F.col("_id").alias(key), "field", F.col("_last.value").alias("value"), F.col("_last._order").alias(order)))


def overlay_documents(base: DataFrame, patches: DataFrame, key: str, body: str = "body", order: str = "seq",
                      protected: Sequence[str] = ("reference",), extra: str = "extra") -> DataFrame:
    """E7a over free-form bodies: ``base`` with its columns overwritten by the
    last value sent for them (a sent null too), and ``extra``, a VARIANT object
    of all other fields sent (null where there are none).

    A value that does not fit its column's type leaves the column null and
    stays in ``extra`` under its name, so nothing sent is lost. A VARIANT
    column ``extra`` of ``base`` is kept and overlaid field by field. One
    record's fields meet in one row, which is the size of its document.
    """
    fields = [c for c in base.columns if c not in (key, extra) and c not in protected]
    last = (patch_fields(patches, key, body, order, protected).groupBy(F.col(key).alias("_key"))
            .agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_sent")))
    rows = base.join(last, base[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    sent = F.col("_sent")

    def typed(v: Column, c: str) -> Column:
        return F.try_variant_get(v, "$", base.schema[c].dataType.simpleString())

    def misfit(name: Column, v: Column) -> Column:
        test = ~name.isin(*fields) if fields else F.lit(True)
        for c in fields:
            test = test | ((name == c) & typed(v, c).isNull() & ~F.is_variant_null(v))
        return test

    out = [F.when(F.map_contains_key(sent, c), typed(sent[c], c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
           for c in base.columns if c != extra]
    new = F.map_filter(sent, misfit)
    if extra in base.columns:
        old = F.variant_get(F.col(extra), "$", "map<string,variant>")
        stays = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(sent, k), F.lit(False)))
        none = F.create_map().cast("map<string,variant>")
        new = F.map_concat(F.coalesce(stays, none), F.coalesce(new, none))
    return rows.select(*out, F.when(F.size(new) > 0, F.to_variant_object(new)).alias(extra))


def document_rejects(base: DataFrame, patches: DataFrame, key: str, body: str = "body", order: str = "seq") -> DataFrame:
    """Patches that change nothing, with the reason: 'not found' for a record
    that is not in ``base``, 'not an object' for a body that is not a JSON
    object (malformed text, a list, a number, nothing)."""
    known = base.select(F.col(key).alias("_key")).withColumn("_known", F.lit(True))
    rows = patches.withColumn("_v", _body(patches, body)).join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
    error = F.when(F.col("_known").isNull(), "not found").when(~_is_object(F.col("_v")), "not an object")
    return rows.select(key, order, error.alias("error")).filter(F.col("error").isNotNull())
