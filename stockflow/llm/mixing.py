"""Mixing sources to target weights by Poisson replication.

A document of a source with mean rate r appears k times, k drawn from
Poisson(r) by inverting its distribution at a hash of the document and the
seed: the same rows give the same mixture on any cluster and after any
retry. Copies are then shuffled globally by another hash. Only DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import packed, small, store


def _hex_number(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def unit_hash(value: Column) -> Column:
    """A number in (0, 1) from a string, in steps of 2**-52."""
    return (_hex_number(value, 13).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Least k with P(X <= k) > u for X ~ Poisson(rate).

    The distribution is summed in log space (no underflow at large rates)
    up to rate + 12 * sqrt(rate) + 30, past which less than 2**-53 is left.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_fact"), F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("k"))

    def step(acc: Column, j: Column) -> Column:
        fact = acc["log_fact"] + F.when(j > 0, F.log(F.greatest(j, F.lit(1)).cast("double"))).otherwise(0.0)
        below = acc["below"] + F.exp(j * F.log(rate) - rate - fact)
        return F.struct(fact.alias("log_fact"), below.alias("below"),
                        (acc["k"] + F.when(below <= u, 1).otherwise(0)).cast("long").alias("k"))

    drawn = F.aggregate(F.sequence(F.lit(0), top), start, step, lambda acc: acc["k"])
    return F.when(rate > 0, drawn).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5,
                 epochs: float = 1.0, size: Column | None = None) -> DataFrame:
    """(source, rate): mean copies per document so that source sizes stand in
    the ratio of their target weights and the whole is ``epochs`` times the
    input size.

    ``weights`` (source, weight) gives the targets; sources it lacks, or with
    a weight that is null or not positive, are left out (rate 0). Without it a
    source's weight is its size to the power ``temperature``. ``size``: what a
    row counts (default: 1).
    """
    sized = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.sum(F.lit(1) if size is None else size).cast("double").alias("size"))
    if weights is None:
        sized = sized.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = weights.select(F.col("source").cast("string").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sized = sized.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sized = store(sized.withColumn("weight", F.when((F.col("weight") > 0) & (F.col("size") > 0), F.col("weight")).otherwise(0.0)), "sizes")
    totals = sized.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(epochs) / F.col("size")).otherwise(0.0)
    return sized.crossJoin(F.broadcast(totals)).select("source", rate.alias("rate"))  # totals: one row


def mix_sources(docs: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` (all columns), each repeated by its draw, plus ``copy``
    (from 1), in a random global order.

    The draw depends on doc_id, source and seed: repeated rows of one id get
    the same count. Sources match null-safe; a source without a rate is left
    out. Null ids, and null, empty or very long texts, are drawn like others; an
    empty table stays empty. An input column named ``copy`` (in any case) is
    replaced, all others stay, whatever they are called.
    """
    rates = rates.select(F.col("source").alias("source"), F.col("rate").alias("rate"))
    rows = packed(docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "copy"]))
    source = F.col("row.source").cast("string")
    name = F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    drawn = rows.join(small(rates), source.eqNullSafe(F.col("source"))).withColumn("k", poisson_inverse(unit_hash(name), F.col("rate"))).filter("k > 0")
    copies = drawn.select("row", name.alias("name"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("copy"))
    place = F.xxhash64("name", "copy", F.lit("order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out and ordered by a hash: uniform whatever the keys, and no sampling pass as a global sort needs.
    return (copies.withColumn("place", place).repartition(parts, "place").sortWithinPartitions("place")
            .select("row.*", "copy"))
