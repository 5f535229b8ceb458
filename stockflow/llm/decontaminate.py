"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, doc_id, text hash, position) of training
tokens. A test set is cut into windows; per window the rarest terms (by
their counts over the whole corpus) are looked up, their lists are shifted
by the term's offset and intersected, and surviving starts are confirmed
word by word. Only the lists that some window reads are stored.

Everything is DataFrame code. The index grows with the corpus and is
sharded by Spark; only tables of the size of the test set are broadcast,
after a count, and joined by a shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import ascii_lower, let, packed, small, split_words, store

# Fixed value: what separates words (everything ASCII but digits and a-z).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null text has none."""
    return split_words(ascii_lower(text), NON_WORD)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, words) per row, written once: cutting texts into
    words costs more than all later passes over them.

    Rows that share an id are told apart by their text; equal rows get equal
    answers.
    """
    return store(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                             words_of(F.col(text_col)).alias("words")), "words")


def phrase_id(words: Column) -> Column:
    """128-bit id of a word sequence (words hold no blanks)."""
    return F.unhex(F.substring(F.sha2(F.array_join(words, " "), 256), 1, 32))


def test_windows(items: DataFrame, window: int = 10, id_col: str = "item_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, members): the word windows (seq, at, wid, words, n) of the
    distinct word sequences among the items, and the items (wid, item_id) that
    hold each. ``seq`` is the sequence's id, ``at`` the window's place in it.

    An item of 1 to ``window`` - 1 words is one window; an item without words,
    or a null one, has none.
    """
    cut = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    cut = cut.withColumn("seq", phrase_id(F.col("all")))
    rows = cut.select("item_id", "seq", F.posexplode(let(F.col("all"), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - window + 1)), lambda i: F.slice(w, i, window)))).alias("at", "words"))
    rows = store(rows.withColumns({"wid": phrase_id(F.col("words")), "n": F.size("words")}), "windows")
    windows = rows.groupBy("seq", "at").agg(*[F.first(c).alias(c) for c in ("wid", "words", "n")])
    return windows, rows.select("wid", "item_id").distinct()


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, postings): occurrences of each of ``terms`` in all texts."""
    tokens = tokens.select(F.explode("words").alias("term"))
    return tokens.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("postings"))


def build_index(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings (term, doc_id, text_hash, pos) of ``tokens``
    (see ``tokenised``), written once.

    ``terms``: one column ``term``; only their lists are stored. None: the
    lists of every term. Null and empty texts have no postings.
    """
    tokens = tokens.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        tokens = tokens.join(small(terms), "term")
    return store(tokens.select("term", "doc_id", "text_hash", "pos"), "postings")


def rarest_lists(windows: DataFrame, counts: DataFrame, lists: int = 2) -> DataFrame:
    """(seq, at, wid, n, places): per window the places in its sequence of its
    ``lists`` rarest terms; windows with a term that the corpus lacks go."""
    terms = (windows.select("seq", "at", "wid", "n", F.posexplode("words").alias("off", "term"))
             .join(counts, "term", "left").withColumn("postings", F.coalesce("postings", F.lit(0))))
    order = F.sort_array(F.collect_list(F.struct("postings", (F.col("at") + F.col("off")).alias("place"), "term")))
    ranked = terms.groupBy("seq", "at", "wid", "n").agg(order.alias("order"))
    return (ranked.filter(F.col("order")[0]["postings"] > 0)
            .withColumn("lists", F.slice("order", 1, lists)).drop("order"))


def phrase_candidates(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Intersection of the offset-adjusted lists: (doc_id, text_hash, start, n,
    wid) where all planned terms of a window stand at their offsets.

    Windows of one test sequence that lie alike on a document share a shift,
    so each posting is shifted once per place of its term, not per window.
    """
    places = plan.select("seq", F.explode("lists").alias("l")).select("seq", "l.place", "l.term").distinct()
    least = plan.groupBy("seq").agg(F.min(F.size("lists")).alias("need"))
    hits = index.join(small(store(places.join(least, "seq"), "places")), "term").withColumn("shift", F.col("pos") - F.col("place"))
    met = (hits.groupBy("doc_id", "text_hash", "seq", "shift", "need").agg(F.collect_set("place").alias("met"))
           .filter(F.size("met") >= F.col("need")))
    wanted = plan.select("seq", "at", "wid", "n", F.col("lists")["place"].alias("wanted"))
    return (met.join(small(wanted), "seq").filter(F.size(F.array_except("wanted", "met")) == 0)
            .select("doc_id", "text_hash", (F.col("shift") + F.col("at")).alias("start"), "n", "wid")
            .filter("start >= 0").distinct())


def phrase_matches(tokens: DataFrame, windows: DataFrame, lists: int = 2) -> DataFrame:
    """Exact occurrences (doc_id, text_hash, start, n, wid) of ``windows`` (see
    ``test_windows``) in ``tokens`` (see ``tokenised``); start counts words from 0.

    Repeated rows of one id and text give one set of matches. Candidates are
    confirmed on the words of their document.
    """
    return _search(tokens, windows, lists)[0]


def near_terms(windows: DataFrame, counts: DataFrame, terms: int) -> DataFrame:
    """(qid, terms): per test sequence its ``terms`` rarest distinct words of
    those that the corpus has, ties by the word; sequences with fewer than two
    of them are left out."""
    held = windows.select("seq", F.explode("words").alias("term")).distinct().join(small(counts), "term")
    rare = F.slice(F.sort_array(F.collect_list(F.struct("postings", "term"))), 1, terms)["term"]
    return held.groupBy(F.col("seq").alias("qid")).agg(rare.alias("terms")).filter(F.size("terms") > 1)


def _search(tokens: DataFrame, windows: DataFrame, lists: int, near: int = 0) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(matches of ``windows``, proximity queries of ``near`` terms each or
    None, the index that holds the lists of both)."""
    windows = store(windows, "distinct-windows")
    vocabulary = store(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = store(term_counts(tokens, vocabulary), "counts")
    plan = store(rarest_lists(windows, counts, lists), "plan")
    wanted = plan.select(F.explode("lists.term").alias("term"))
    queries = store(near_terms(windows, counts, near), "near") if near else None
    if queries is not None:
        wanted = wanted.union(queries.select(F.explode("terms")))
    index = build_index(tokens, store(wanted.distinct(), "terms"))
    found = store(phrase_candidates(index, plan), "candidates")
    key = ["_id", "_hash"]
    per_doc = (found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct("wid", "start", "n").alias("c"))
               .groupBy(*key).agg(F.collect_list("c").alias("found")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    # Only documents with a candidate are looked at again.
    few = small(store(per_doc.select(*key), "candidate-ids"))
    held = tokens.join(few, same, "left_semi").join(per_doc, same)
    sure = held.select("doc_id", "text_hash", F.filter(
        "found", lambda c: phrase_id(F.slice("words", c["start"] + 1, c["n"])) == c["wid"]).alias("sure"))
    return sure.select("doc_id", "text_hash", F.explode("sure").alias("m")).select(
        "doc_id", "text_hash", "m.start", "m.n", "m.wid").distinct(), queries, index


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(qid, doc_id, text_hash, first, last): places where all terms of a query
    (qid, terms) stand, in any order, within ``span`` consecutive words.

    ``last`` is the place of the closing term and ``first`` that of the
    earliest of the query's terms in the same span. A query without terms
    matches nothing.
    """
    terms = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"),
                           F.size(F.array_distinct("terms")).alias("need"))
    near = (Window.partitionBy("qid", "doc_id", "text_hash").orderBy("pos").rangeBetween(-(span - 1), 0))
    seen = index.join(small(terms), "term").select("qid", "doc_id", "text_hash", "need", "pos",
                                            F.size(F.collect_set("term").over(near)).alias("got"),
                                            F.min("pos").over(near).alias("first"))
    return seen.filter("got = need").select("qid", "doc_id", "text_hash", "first", F.col("pos").alias("last")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, lists: int = 2,
                  id_col: str = "doc_id", text_col: str = "text", near: int = 3, span: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a
    matched window), n_items, items_sha256 (of the sorted ids of items that
    matched), contaminated, n_near (test texts, equal ones once, whose ``near``
    rarest words stand within ``span`` consecutive words, in any order: a trace
    of reworded items, which alone does not contaminate).

    Null or empty text: no words and not contaminated; texts of any length are
    searched whole. Repeated rows each get their row; rows that share an id are
    judged on their own texts. An item with a null id counts in n_hit, but has
    no id to count in n_items. An empty table gives no rows, empty ``items`` no
    hits. Extra columns are ignored.
    """
    windows, members = test_windows(items, window)
    tokens = tokenised(docs, id_col, text_col)
    matches, queries, index = _search(tokens, windows, lists, near)
    matches = store(matches, "matches")
    close = (proximity_matches(index, queries, span).groupBy(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash"))
             .agg(F.count_distinct("qid").alias("n_near")))
    spans = matches.select("doc_id", "text_hash", "start", "n").distinct()
    hit = (spans.select("doc_id", "text_hash", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p"))
           .distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit")))
    named = (matches.select("doc_id", "text_hash", "wid").distinct().join(members, "wid")
             .select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    both = hit.join(named, hit["doc_id"].eqNullSafe(named["doc_id"]) & (hit["text_hash"] == named["text_hash"]), "left").select(
        hit["doc_id"].alias("_id"), hit["text_hash"].alias("_hash"), "n_hit", "items")
    rows = tokens.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    out = rows.join(both, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash")), "left")
    out = out.join(store(close, "close"), rows["doc_id"].eqNullSafe(F.col("_near_id")) & (rows["text_hash"] == F.col("_near_hash")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(names).cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text holds no window of ``items``.

    Null and empty texts stay, texts of any length are searched whole, and an
    empty table stays empty. Rows that share an id, or are equal, go by their
    own texts. Items with a null id count like others; null and empty items
    match nothing. Columns may have any names.
    """
    tokens = tokenised(docs)
    matches = phrase_matches(tokens, test_windows(items, window)[0])
    found = store(matches.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    rows = packed(docs)
    return rows.join(small(found), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash")), "left_anti").select("row.*")
