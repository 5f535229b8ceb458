import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stockflow.llm.decontaminate import NON_WORD, build_index, decontaminate, proximity_matches, tokenised
from stockflow.llm.packing import segments
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.util import ODD, SCHEMA, SF, empty_docs, odd_docs, sf_docs


def words(text):
    import re

    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [w for w in re.split(NON_WORD + "+", (text or "").translate(str.maketrans(up, up.lower()))) if w]


def hits(text, items, n=10):
    """Places of words inside a window, and items with a window, by brute force."""
    w, covered, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for a in range(max(1, len(x) - n + 1) if x else 0):
            win = x[a:a + n]
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    covered.update(range(s, s + len(win)))
                    found.add(str(item))
    return len(w), len(covered), sorted(found)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "Short one"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"),
         (5, "a b c a b c"), (6, "the quick brown fox jumps over the lazy dog again, and MORE"), (None, "no id here")]


def test_decontaminate_odd_rows(spark):
    texts = ["xx the quick brown fox jumps over the lazy dog again and again yy", "SHORT, one; short one", "a " * 40, "the quick brown fox jumps over the lazy cat"]
    rows = [r[:2] for r in ODD] + [(100 + i, t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(rows[len(ODD):], "doc_id long, text string")), items)
    import hashlib

    known = [(i, t) for i, t in ITEMS if i is not None]
    want = sorted(((i, *hits(t, ITEMS)[:2], len(f := hits(t, known)[2]), hashlib.sha256(",".join(f).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()), key=str) == want
    assert decontaminate(empty_docs(spark), items).collect() == []
    none = decontaminate(odd_docs(spark), items.filter("false")).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none)


def test_proximity(spark):
    rows = [(1, "red x x blue x green"), (2, "green blue red"), (3, "red x x x x x blue green"), (4, "red blue")]
    index = build_index(tokenised(spark.createDataFrame(rows, "doc_id long, text string")))
    queries = spark.createDataFrame([(7, ["red", "blue", "green"]), (8, [])], "qid long, terms array<string>")
    assert {(r.qid, r.doc_id, r["first"], r["last"]) for r in proximity_matches(index, queries, 6).collect()} == {(7, 1, 0, 5), (7, 2, 0, 2)}


def test_near_counts_match_brute_force(spark):
    import collections
    import random

    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 90)))) for i in range(60)] + [(90, None), (91, "Solo")]
    items = [(i, " ".join(rng.sample(vocab, rng.randrange(1, 9))) + (" unseen" if i % 2 else "")) for i in range(20)] + [(50, "solo"), (51, "unseen never"), (3, None)]
    n = collections.Counter(w for _, t in docs for w in words(t))
    rare = {tuple(words(t)): sorted((n[w], w) for w in set(words(t)) if n[w])[:3] for _, t in items if words(t)}
    got = {r.doc_id: r.n_near for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=12).collect()}
    for i, t in docs:
        w = words(t)
        assert got[i] == sum(len(q) > 1 and any({x for _, x in q} <= set(w[a:a + 12]) for a in range(len(w))) for q in rare.values())


def test_stages(spark):
    docs = sf_docs(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    clean = P.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    gone = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 0").count() <= gone.count() * 0.2
    left = P.near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    want = {i for i, _, _, kept in near_brute([(r.doc_id, r.text) for r in docs.collect()], 80) if kept}
    assert {r.doc_id for r in left.collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not hits(r.text, items)[1]}
    mixed = P.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.subtract(docs).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = sf_docs(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    got = segments(P.run(spark, SF)).groupBy("doc_id").agg(F.sum(F.length("ids") / 2).cast("long").alias("n")).collect()
    whole = segments(P.packing(spark, docs, SF)).groupBy("doc_id").agg(F.sum(F.length("ids") / 2).cast("long").alias("n")).collect()
    assert sorted(got) == sorted(whole) and {r.doc_id for r in got} == {r.doc_id for r in docs.filter("length(text) > 0").select("doc_id").distinct().collect()}


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_bear_odd_and_empty_tables(spark, stage, tmp_path):
    spark.createDataFrame([(1, None, 1), (4, 1, 0), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, odd_docs(spark), str(tmp_path))
    assert out.count() >= 0
    if stage is P.near_duplicates:
        assert sum(r.doc_id == 5 for r in out.collect()) == 1 and sum(r.text is None for r in out.collect()) == 2
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


# Names that the operators use inside, and some of the language.
INSIDE = ["_k", "_place", "_source", "_rate", "_name", "Copy", "_id", "_hash", "_score", "row", "source_", "rate", "k", "name", "place", "score",
          "_doc", "_text", "text_hash", "words", "kept", "component", "n", "same", "regs", "keys", "a.b", "select"]


def test_stages_bear_any_column_name_and_change_no_value(spark):
    base = sf_docs(spark).limit(60)
    docs = base.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in INSIDE])
    want = {r["doc_id"]: tuple(r[c] for c in ("text", "lang", *INSIDE)) for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        names = [c for c in out.columns if c.lower() != "copy"]
        assert names == [c for c in docs.columns if c.lower() != "copy"], name
        some = 0
        cols = [c for c in ("text", "lang", *INSIDE) if c in out.columns]
        for r in out.collect():
            some += 1
            mine = dict(zip(("text", "lang", *INSIDE), want[r["doc_id"]]))
            assert all(r[c] == mine[c] for c in cols), name
        assert some
