"""Quality rules with adaptive thresholds.

Per language and source, mergeable quantile sketches of each measure (counts
by bins of equal relative width, which add up in any order, so results repeat)
give fences beyond the group's own quartiles; a text outside a fence by more
than its length explains is rejected. The quantiles of a group lean towards its
language's, and those towards all rows', the more the fewer texts it has. The
fixed rules (``base_failed``) hold besides. Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import BLANK, let, small, split_words, store

# measure -> (what it is counted over, how many of them come together, fenced below too)
MEASURES: dict[str, tuple[str, int, bool]] = {
    "mean_word_length": ("n_words", 1, True),
    "symbol_share": ("word_chars", 1, False),
    "dup_line_share": ("n_lines", 1, False),
    "repeat_share": ("n_words", 3, False),  # whole windows
}
FENCE = 5.0          # spreads from a quartile to its fence
RANKS = (0.15, 0.25, 0.5, 0.75, 0.85)
PRIOR = 30.0         # texts that a group's language counts as in its quantiles
ERRORS = 2.0         # standard errors of a text's own measure that pass beyond a fence
STEP = 1.02          # ratio of neighbouring bins: a quantile's value is right to 1 %
# A tiny allowance below which no share is held against a text, whatever its group.
LEAST = {"symbol_share": 0.002, "dup_line_share": 0.01, "repeat_share": 0.01}


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more (the
    first one included).

    Windows are hashed, hash and place packed into one long, and sorted:
    equal windows become neighbours. Linear memory, n log n time, also for
    very long texts.
    """
    def covered(w: Column, h: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))

        def twice(p: Column) -> Column:
            at = lambda x: F.get(h, x.bitwiseAND(mask).cast("int"))
            same = lambda x, j: F.coalesce(at(x) == at(F.get(p, j)), F.lit(False))
            places = F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(places, lambda x: x.bitwiseAND(mask)))

        def length(q: Column) -> Column:
            steps = F.transform(q, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(q, j + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(packed, twice), length)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2),
                         lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    bits = F.length(F.bin(F.size(words))).cast("int")
    return (F.when(F.size(words) < 3, F.lit(0).cast("long"))
             .otherwise(let(hashes, lambda h: let(bits, lambda b: covered(words, h, b)))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each row's whole text: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. Null and empty
    texts have zero of each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       let(split_words(text, BLANK), lambda w: F.struct(
                           F.size(w).cast("long").alias("n_words"),
                           F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                           repeat_words(w).alias("n_repeat_words"))).alias("m"),
                       let(lines, lambda x: F.struct(
                           F.size(x).cast("long").alias("n_lines"),
                           (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
                       (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))
    return base.select("doc_id", "lang", "source", "m.*", "l.*", "n_symbols")


def _shares(m: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return m.withColumns({"mean_word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
                          "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def sketches(shares: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketches, one row per bin that has
    texts (some thousand at most per measure); texts without words are left
    out. Values of 0 have the lowest bin."""
    each = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in MEASURES])
    rows = shares.filter("n_words > 0").select("lang", "source", F.inline(each))
    place = F.when(F.col("value") > 0, F.floor(F.log("value") / math.log(STEP)).cast("int")).otherwise(F.lit(-(2 ** 31)))
    return rows.groupBy("lang", "source", "measure", place.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q): the values at ``RANKS``, and last what rare
    values amount to: the median of those above 0, times how often there are
    any and how often there are none."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "measure")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.col("bin") == -(2 ** 31)
    rows = merged.select(*keys, "measure", F.when(zero, 0.0).otherwise(F.pow(F.lit(STEP), F.col("bin") + 0.5)).alias("value"),
                         F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("total"),
                         F.coalesce(F.sum(F.when(zero, F.col("n"))).over(of), F.lit(0)).alias("none"))
    at = [F.min(F.when(F.col("upto") >= r * F.col("total"), F.col("value"))) for r in RANKS]
    middle = F.min(F.when((F.col("value") > 0) & (F.col("upto") - F.col("none") >= 0.5 * (F.col("total") - F.col("none"))), F.col("value")))
    share = F.first("none") / F.first("total")
    return rows.groupBy(*keys, "measure").agg(F.first("total").alias("total"), F.array(*at, F.coalesce(middle, F.lit(0.0)) * share * (1 - share)).alias("q"))


def fences(groups: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>) from ``sketches``.

    A fence lies ``FENCE`` spreads beyond a quartile. A spread is the way from
    the median to the quartile or from there to the outer 15 %, or what rare
    values amount to, whichever is longest: where most texts have none, the
    fence comes from those that have some and how many they are.
    """
    own = quantiles(groups, ["lang", "source"]).select("lang", "source", "measure", F.col("total").alias("n1"), F.col("q").alias("q1"))
    langs = quantiles(groups, ["lang"]).select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.col("total").alias("n2"), F.col("q").alias("q2"))
    every = quantiles(groups, []).select(F.col("measure").alias("m3"), F.col("q").alias("q3"))
    rows = (own.join(langs, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2")))
            .join(every, F.col("measure") == F.col("m3")))

    def leaning(q: Column, n: str, to: Column) -> Column:
        return F.zip_with(q, to, lambda x, y: (F.col(n) * x + PRIOR * y) / (F.col(n) + PRIOR))

    rows = rows.withColumn("q", leaning(F.col("q1"), "n1", leaning(F.col("q2"), "n2", F.col("q3"))))
    q15, q25, q50, q75, q85, rare = (F.get("q", F.lit(i)) for i in range(len(RANKS) + 1))
    high, low = q75 + FENCE * F.greatest(q75 - q50, q85 - q75, rare), q25 - FENCE * F.greatest(q50 - q25, q25 - q15)
    out = []
    for c, (*_, two_sided) in MEASURES.items():
        mine = lambda x: F.max(F.when(F.col("measure") == c, x))  # noqa: E731, B023
        out.append(mine(high if two_sided else F.greatest(high, F.lit(LEAST[c]))).alias(f"high_{c}"))
        out.append((mine(low) if two_sided else F.lit(float("-inf"))).alias(f"low_{c}"))
    return rows.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*out)


def _inside(c: str, over: str, together: int, two_sided: bool) -> Column:
    """Whether a measure is inside its fences, give or take ``ERRORS`` standard
    errors: a few words or lines tell a share only roughly. A share's are those
    of a proportion at the fence (Wilson's bound, so that a fence of 0 has some
    too); word lengths are taken to vary by their mean."""
    n, low, high = F.greatest(F.col(over), F.lit(1)).cast("double") / together, F.col(f"low_{c}"), F.col(f"high_{c}")
    if two_sided:
        error = ERRORS * F.col(c) / F.sqrt(n)
        return F.col(c).between(low - error, high + error)
    z, p = ERRORS ** 2, F.least(high, F.lit(1.0))
    return F.col(c) <= (p + z / (2 * n) + ERRORS * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: under 50 words, or over half of them in repeated windows.
    kept: not base_failed and every measure inside its group's fences, give or
    take the error that the text's length leaves. Null
    language or source is a group of its own; null and empty texts fail, and
    texts of any length are measured whole. Repeated rows each get their row
    and count each; an empty table gives no rows. Extra columns are ignored.
    """
    shares = _shares(store(measures(docs), "measures"))
    limits = store(fences(store(sketches(shares), "sketches")), "fences")
    rows = shares.join(small(limits), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for c, (over, together, two_sided) in MEASURES.items():
        inside = inside & F.coalesce(_inside(c, over, together, two_sided), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & inside).alias("kept"))
