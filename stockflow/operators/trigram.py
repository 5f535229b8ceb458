"""Substring search by a trigram index.

A posting says that a record's field holds three given characters in a row
(lower-cased). A record that contains a term holds all of the term's trigrams
in one field, so lists of the term's rarest trigrams are intersected, and the
few records left are tested exactly. A field of one or two characters is its
own gram, and a term of one or two characters is looked up in all grams that
contain it, so every term has the same answer as a scan of all records.

Postings are written sorted by gram: a search reads the row groups of its
grams. A gram that many records share is many rows, dealt over many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.scalars import contains_ci

GRAM = 3
LISTS = 4   # rarest lists that are intersected; the exact test does the rest


def grams(text: Column) -> Column:
    """Distinct grams of a lower-cased text; none of a null or empty one."""
    n = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _postings(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, gram) of all records."""
    texts = [F.lower(F.col(f).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)])
    # Records are told apart before they are cut into grams: a key comes once
    # per gram unless it has several records of different texts.
    return (df.select(F.col(key).alias("key"), *texts).distinct().select("key", F.explode(each).alias("f")).filter("f.text is not null")
            .select("key", "f.field", F.explode(grams(F.col("f.text"))).alias("gram")))


def build_index(df: DataFrame, key: str, fields: Sequence[str], path: str) -> None:
    """Write the postings (field, gram, key) of ``df`` under ``path``, and how
    long each list is."""
    spark = df.sparkSession
    rows = _postings(df, key, fields)
    order = ["field", "gram", "key"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram", "field").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/lists")


def term_grams(term: str) -> list[str]:
    return list(dict.fromkeys(term[i:i + GRAM] for i in range(len(term) - GRAM + 1)))


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(key) of the records that may contain ``term``: all that do, and few others."""
    low = term.lower()
    postings, lists = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lists")
    if len(low) < GRAM:
        return postings.filter(F.col("gram").contains(low)).select("key").distinct()
    asked = term_grams(low)
    # As many rows as the term has grams and the index fields.
    found = lists.filter(F.col("gram").isin(asked)).collect()
    keys = []
    for field in sorted({r["field"] for r in found}):
        mine = sorted((r["n"], r["gram"]) for r in found if r["field"] == field)
        if len(mine) == len(asked):  # else no record has them all in this field
            rare = [g for _, g in mine[:LISTS]]
            hits = postings.filter((F.col("field") == field) & F.col("gram").isin(rare)).groupBy("key").agg(F.count_distinct("gram").alias("n"))
            keys.append(hits.filter(F.col("n") == len(rare)).select("key"))
    if not keys:
        return postings.select("key").limit(0)
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


def search_index(df: DataFrame, path: str, key: str, fields: Sequence[str], term: str) -> DataFrame:
    """B5 by the index that ``build_index`` wrote for ``df``: its records with
    ``term`` in any of ``fields``, whatever the case. An empty term matches
    every record; records with a null key are only found by it."""
    if term == "":
        return df
    hit = candidates(df.sparkSession, path, term).withColumnRenamed("key", "_key")
    test = F.lit(False)
    for f in fields:
        test = test | contains_ci(f, term)
    return df.join(hit, F.col(key) == F.col("_key"), "left_semi").filter(test)
