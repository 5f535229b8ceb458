"""Line dedup: whole result against a plain version, runs against plain counts."""

import hashlib
import random
import string

from pyspark.sql import functions as F

from stockflow.llm import line_dedup as L
from tests.llm.util import SCHEMA, empty_docs, odd_docs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(texts, least):
    """(n_lines, n_dropped, kept text) per text; every text is a document."""
    lines = [(t or "").split("\n") for t in texts]
    seen = {}
    for ls in lines:
        for k in {key(x) for x in ls} - {""}:
            seen[k] = seen.get(k, 0) + 1
    often = {k for k, n in seen.items() if n >= least}
    out = []
    for ls in lines:
        kept = [x for x in ls if key(x) not in often]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def random_texts(n, seed=5):
    rng = random.Random(seed)
    vocab = ["same line", " Same Line\t", "Éa", "éa", "", "  ", "\x0b", "tail\r", "TAIL", "only here"] + [f"line {i}" for i in range(60)]
    return ["\n".join(rng.choice(vocab) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + [None, "\n", "\n\n\n", "same line\nsame line"]


def test_matches_brute_force_for_any_batches_and_fanout(spark):
    texts = random_texts(150)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    for least, batches, fanout in ((10, 4, 2), (3, 7, 3), (1, 1, 2), (40, 5, 9)):
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"])
               for r in L.line_dedup(docs, least, batches, fanout).select("doc.doc_id", "lines.*").collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, least)


def test_odd_rows_keep_their_columns(spark):
    docs = odd_docs(spark).withColumns({c: F.lit("mine") for c in ("id", "mark", "lines", "gone", "doc", "h1", "pos", "batch", "n_lines")})
    rows = L.line_dedup(docs, least=2, batches=3).collect()
    source = docs.collect()
    assert sorted(map(str, (r["doc"].asDict() for r in rows))) == sorted(map(str, (r.asDict() for r in source)))
    want = sorted(zip([str(r["text"]) for r in source], brute([r["text"] for r in source], 2)))
    assert sorted((str(r["doc"]["text"]), tuple(r["lines"])) for r in rows) == want


def test_empty_table_and_digest(spark):
    assert L.digests(L.line_dedup(empty_docs(spark))).collect() == []
    docs = spark.createDataFrame([(1, "a\nb", "en", "a", 0)], SCHEMA)
    assert tuple(L.digests(L.line_dedup(docs, least=2)).first()) == (1, 2, 0, hashlib.sha256(b"a\nb").hexdigest())


def test_a_line_in_every_document_and_very_long_texts(spark):
    texts = ["Common\n" + "\n".join(f"{i} {j}" for j in range(3)) for i in range(300)]
    texts += ["\n".join(["common", "x"] * 40_000), "\n".join(f"u{i}" for i in range(60_000))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: tuple(r["lines"]) for r in L.line_dedup(docs).select("doc.doc_id", "lines").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 10)


def test_runs_are_levelled_and_later_batches_meet_them(spark):
    def batch(*keys):
        return spark.createDataFrame([(k, -k, 1) for k in keys], "h1 long, h2 long, n long")

    runs = L.LineRuns(spark, least=3, buckets=4, fanout=2)
    for b in ((1, 2, 1), (2, 3, 1), (1, 4, 2), (2, 5, 5), (6, 1, 2)):
        runs.add(batch(*b))
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches: 4 + 1
    assert sorted(r[0] for r in runs.frequent().collect()) == [1, 2]
    assert sorted(r[0] for r in runs.unseen(batch(1, 7, 8, 6)).collect()) == [7, 8]
    assert sorted(r[0] for r in runs.unsettled(batch(1, 7, 5, 6)).collect()) == [5, 6, 7]
    # A settled key is not counted again: the last run has no row for 1 and 2.
    assert sorted(r["h1"] for r in runs.levels[0][0].collect()) == [6]


def test_runs_are_joined_and_merged_without_moving_them(spark):
    runs = L.LineRuns(spark, least=3, buckets=4, fanout=3)
    rows = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"))
    runs.add(rows)
    runs.add(rows.filter("id < 500"))
    merged = runs._merged(runs.runs())
    assert {(r["h2"], r["n"]) for r in merged.collect()} == {(i, 2 if i < 500 else 1) for i in range(1000)}
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_every_run_has_one_row_per_key(spark):
    runs = L.LineRuns(spark, least=4, buckets=5, fanout=3)
    for b in range(8):
        keys = [(i, i, 1) for i in range(40) if i % (b + 2) < 2]
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, n long"))
    want = {i: sum(i % (b + 2) < 2 for b in range(8)) for i in range(40)}
    for run in runs.runs():
        assert run.count() == run.select("h1", "h2").distinct().count()
    assert sorted(r[0] for r in runs.frequent().collect()) == [i for i in range(40) if want[i] >= 4]
