import random

from stockflow.llm.suffixes import repeated_passages
from tests.llm.util import ODD, empty_docs, odd_docs, sf_docs


def brute(rows, least=50):
    where, cut = {}, [(i, t, (t or "").encode().lower().split()) for i, t in rows if i is not None]
    for i, _, w in cut:
        for s in range(len(w) - least + 1):
            where.setdefault(tuple(w[s:s + least]), set()).add(i)
    out = set()
    for i, t, w in cut:
        covered = set()
        for s in range(len(w) - least + 1):
            if len(where[tuple(w[s:s + least])]) > 1:
                covered.update(range(s, s + least))
        if covered:
            edges = sorted(p for p in covered if p - 1 not in covered), sorted(p + 1 for p in covered if p + 1 not in covered)
            out.add((i, tuple(zip(*edges, strict=True)), len(covered), t))
    return sorted(x[:3] for x in out)


def result(df):
    return sorted((r.doc_id, tuple((s.start, s.end) for s in r.spans), r.n_repeated) for r in df.collect())


def test_small_tables(spark):
    docs = sf_docs(spark)
    assert result(repeated_passages(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_overlaps_of_every_length(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    source = [word() for _ in range(300)]
    rows = [(0, " ".join(source))]
    for i in range(1, 120):
        a = rng.randrange(220)
        n = rng.randrange(40, 75)
        rows.append((i, " ".join([word() for _ in range(rng.randrange(30))] + source[a:a + n] + [word() for _ in range(rng.randrange(30))])))
    rows += [(200 + i, " ".join(["For"] * (40 + 9 * i))) for i in range(8)] + [(300, " ".join(["abc"] * 5000))]
    rows += [(400 + i, " ".join(source[:60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(repeated_passages(docs)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    more = spark.createDataFrame([(50, ODD[3][1][1000:9000])], "doc_id long, text string")
    rows = [r[:2] for r in ODD] + [(50, ODD[3][1][1000:9000])]
    assert result(repeated_passages(docs.select("doc_id", "text").union(more))) == brute(rows)
    assert repeated_passages(empty_docs(spark)).collect() == []
