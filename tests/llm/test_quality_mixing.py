import collections

import pytest
from pyspark.sql import functions as F

from stockflow.llm.mixing import mix_sources, poisson_inverse, source_rates
from stockflow.llm.quality_rules import quality_rules
from tests.llm.util import ODD, empty_docs, odd_docs, sf_docs


def brute(text):
    w = (text or "").encode().split()
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def rows(df):
    return sorted((tuple(r[c] for c in ["doc_id", *BASE]) for r in df.collect()), key=str)


def test_quality_base_matches_brute_force(spark):
    docs = sf_docs(spark)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert rows(quality_rules(docs)) == want


def test_quality_odd_rows(spark):
    got = quality_rules(odd_docs(spark))
    assert rows(got) == sorted(((i, *brute(t)) for i, t, *_ in ODD), key=str)
    assert all(not (r.kept and r.base_failed) for r in got.collect())
    assert quality_rules(empty_docs(spark)).collect() == []


def test_quality_rejects_symbol_junk_and_keeps_clean(spark):
    clean = [(i, " ".join(f"{a}{i}thing{j}" for j, a in enumerate("some plain words of text here".split() * 20)), "en", "s", 1) for i in range(150)]
    junk = [(1000 + i, t.replace(" ", "$$$ "), "en", "s", 1) for i, t, *_ in clean[:10]]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(10))


def test_quality_fences_follow_the_group(spark):
    """The same text in a source of prose, in one where two texts of five have
    formulas (its median is 0), and in a small one of formulas."""
    def text(i, symbols):
        words = [f"{a}{i}x{j}" for j, a in enumerate("some plain words of text here".split() * 20)]
        return " ".join(w + "$" * (j < symbols) for j, w in enumerate(words))

    prose = [(i, text(i, 0), "en", "prose", 1) for i in range(400)]
    maths = [(1000 + i, text(1000 + i, 70 + i % 21 if i % 5 < 2 else 0), "en", "maths", 1) for i in range(400)]
    few = [(2000 + i, text(2000 + i, 70 + i % 21), "fr", "maths", 1) for i in range(60)]
    same = [(5001, text(5000, 85), "en", "prose", 1), (5002, text(5000, 85), "en", "maths", 1), (5003, text(5000, 85), "fr", "maths", 1)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(prose + maths + few + same, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[5001] and got[5002] and got[5003]
    assert all(got[i] for i, *_ in prose + maths + few)


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 300.0])
def test_poisson_inverse(spark, rate):
    import math

    us = [0.0001, 0.1, 0.37, 0.5, 0.9, 0.9999, 1 - 2 ** -53]
    df = spark.createDataFrame([(u, rate) for u in us], "u double, r double")
    got = [r.k for r in df.select(poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect()]
    for u, k in zip(us[:-1], got):
        cdf, n = math.exp(-rate), 0
        while cdf <= u and rate:
            n += 1
            cdf += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        assert k == n
    assert got == sorted(got)


def test_mixing_reaches_targets_and_repeats(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                      F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    mixed = mix_sources(docs, source_rates(docs, weights))
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["big"] - 10_000) < 500 and abs(got["small"] - 10_000) < 500
    again = mix_sources(docs.repartition(7), source_rates(docs, weights))
    key = lambda df: sorted((r.doc_id, r.copy) for r in df.collect())
    assert key(mixed) == key(again)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    out = mix_sources(docs, source_rates(docs, epochs=50.0))
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert {r.source for r in out.collect()} == {"a", "b", None}
    none = source_rates(docs, spark.createDataFrame([("a", None), ("zz", 1.0)], "source string, weight double"))
    assert mix_sources(docs, none).count() == 0
    assert mix_sources(empty_docs(spark), source_rates(empty_docs(spark))).count() == 0


def plain_kept(rows):
    """{doc_id: kept} from (doc_id, text, lang, source) rows, in plain Python."""
    import math
    import statistics  # noqa: F401

    from stockflow.llm import quality_rules as Q

    def share(a, b):
        return a / max(b, 1)

    shares, sizes = {}, {}
    for i, text, lang, source in rows:
        w, chars, symbols, dup, rep, failed = brute(text)
        lines = len([x for x in (text or "").split("\n") if x.encode().split()])
        shares[i] = {"mean_word_length": share(chars, w), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, lines), "repeat_share": share(rep, w)}
        sizes[i] = {"n_words": w, "word_chars": chars, "n_lines": lines, "failed": failed}

    def quantiles(values):
        bins = sorted((0.0 if v <= 0 else Q.STEP ** (math.floor(math.log(v) / math.log(Q.STEP)) + 0.5)) for v in values)
        n, some = len(bins), [b for b in bins if b > 0]
        at = lambda xs, r: next(x for k, x in enumerate(xs, 1) if k >= r * len(xs))
        none = 1 - len(some) / n
        return [*(at(bins, r) for r in Q.RANKS), (at(some, 0.5) if some else 0.0) * none * (1 - none)]

    out = {}
    counted = [r for r in rows if sizes[r[0]]["n_words"]]
    for i, text, lang, source in rows:
        kept = not sizes[i]["failed"]
        for c, (over, together, two_sided) in Q.MEASURES.items() if kept else ():
            groups = [[shares[j][c] for j, _, g, s in counted if g == lang and s == source], [shares[j][c] for j, _, g, _ in counted if g == lang], [shares[j][c] for j, *_ in counted]]
            lean = lambda q, n, to: [(n * x + Q.PRIOR * y) / (n + Q.PRIOR) for x, y in zip(q, to)]
            q15, q25, q50, q75, q85, rare = lean(quantiles(groups[0]), len(groups[0]), lean(quantiles(groups[1]), len(groups[1]), quantiles(groups[2])))
            high, v, n = q75 + Q.FENCE * max(q75 - q50, q85 - q75, rare), shares[i][c], max(sizes[i][over], 1) / together
            if two_sided:
                low, error = q25 - Q.FENCE * max(q50 - q25, q25 - q15), Q.ERRORS * v / math.sqrt(n)
                kept &= low - error <= v <= high + error
            else:
                z, p = Q.ERRORS ** 2, min(max(high, Q.LEAST[c]), 1.0)
                kept &= v <= (p + z / (2 * n) + Q.ERRORS * math.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
        out[i] = kept
    return out


def test_quality_verdicts_match_the_plain_version_and_repeat(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [{r.doc_id: r.kept for r in quality_rules(d).collect()} for d in (docs, docs.repartition(7), docs.repartition(2, "lang"))]
    assert got[0] == got[1] == got[2]
    assert got[0] == plain_kept([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert 0 < sum(got[0].values()) < len(got[0])


def test_quality_few_symbols_in_a_long_clean_text(spark):
    """No text of the group but this one has any symbol."""
    def text(i, n):
        return " ".join(f"{a}{i}x{j}" for j, a in enumerate("some plain words of text here".split() * n))

    clean = [(i, text(i, 20), "en", "s", 1) for i in range(150)]
    long = (900, text(900, 850).replace("plain900x1 ", "$5 $6 "), "en", "s", 1)
    long = (900, long[1] + " costs $7 and $8", "en", "s", 1)
    junk = [(1000 + i, text(1000 + i, 20).replace(" ", "$$$ "), "en", "s", 1) for i in range(10)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame([*clean, long, *junk], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[900] and all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(10))


def test_quality_fences_differ_between_groups(spark):
    from stockflow.llm import quality_rules as Q

    shares = Q._shares(Q.measures(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    rows = Q.fences(Q.sketches(shares)).collect()
    assert len(rows) > 20
    for c in ("symbol_share", "mean_word_length", "repeat_share"):
        assert len({round(r[f"high_{c}"], 6) for r in rows}) > len(rows) / 2
