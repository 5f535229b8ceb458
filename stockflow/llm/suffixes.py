"""Passages that repeat across documents, by a sparse suffix array.

Only suffixes that start at minimisers are kept: among every ``WINDOW``
consecutive word runs the one of least hash is chosen by content, so two
documents that share a passage keep the same places in it. The suffixes are
sorted by fingerprints of their first words, neighbours are compared, and
matches are extended to the left and right on the documents' words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import small, store
from stockflow.llm.hashing import Prefix, WordHashes

LEAST = 50     # words of a passage that count as a repeat
WINDOW = 20    # a minimiser among so many consecutive runs
RUN = 8        # words of a run


def right_words(least: int) -> int:
    """The place that a passage's first window of runs chooses lies among its
    first ``WINDOW`` words: so many words at least follow in the passage."""
    return least - WINDOW + 1


def word_hashes(text: str | None, words: WordHashes) -> np.ndarray:
    """Hashes of the blank-delimited words after lower-casing A-Z."""
    return words.of((text or "").encode().lower().split())


def _frame(columns: tuple[str, ...], parts: list[tuple]) -> pd.DataFrame:
    """One frame from per-document tuples of arrays and (doc_id, text_hash)."""
    size = [len(p[1]) for p in parts]
    of = {c: np.concatenate([p[k + 1] for p in parts]) for k, c in enumerate(columns)}
    of["doc_id"] = np.repeat(np.array([p[0][0] for p in parts], np.int64), size)
    of["text_hash"] = np.repeat(np.array([p[0][1] for p in parts], np.int64), size)
    return pd.DataFrame(of)


def minimisers(h: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, last): the minimisers (leftmost on ties), ascending,
    and the first and last window of runs that chose each."""
    g = h.runs(RUN)
    if len(g) < WINDOW:
        return (np.empty(0, np.int64),) * 3
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    chosen = np.concatenate([view[at:at + 65536].argmin(axis=1) + np.arange(at, min(at + 65536, len(view))) for at in range(0, len(view), 65536)])
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return chosen[new], new, np.append(new[1:], len(chosen)) - 1


def _suffixes(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    words, right = WordHashes(), right_words(least)
    for pdf in batches:
        parts = []
        for doc_id, text_hash, text in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"], strict=True):
            h = word_hashes(text, words)
            n = len(h)
            if n < least:
                continue
            h = Prefix(h)
            at, low, high = minimisers(h)
            keep = at + right <= n
            at, low, high = at[keep], low[keep], high[keep]
            long = np.zeros(len(at), np.int64)  # 0: fewer than ``least`` words follow
            whole = at + least <= n
            long[whole] = h.runs(least, at[whole]).astype(np.int64)
            parts.append(((doc_id, text_hash), h.runs(right, at).astype(np.int64), long, at.astype(np.int32),
                          low.astype(np.int32), high.astype(np.int32)))
        if parts:
            yield _frame(("short", "long", "pos", "low", "high"), parts)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From sorted suffixes those that share their first words with another
    document's (sure), and those of the first and last run of the task, which
    other tasks may continue (edge). core: shares the longer prefix, too."""

    def told(run: pd.DataFrame, edge: bool) -> pd.DataFrame | None:
        sure = run["doc_id"].iat[0] != run["doc_id"].iat[-1] or run["doc_id"].nunique() > 1
        if not sure and not edge:
            return None
        docs = run.groupby("long", sort=False)["doc_id"].transform("nunique")
        return run.assign(core=(run["long"] != 0) & (docs > 1), sure=sure, edge=edge)

    held: pd.DataFrame | None = None
    first = True
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = pdf["short"].to_numpy()
        last = len(key) - 1
        while last and key[last - 1] == key[-1]:  # the last run may go on
            last -= 1
        held, done = pdf.iloc[last:], pdf.iloc[:last]
        if first and len(done):
            n = int(np.argmax(key[:last] != key[0])) if (key[:last] != key[0]).any() else last
            yield told(done.iloc[:n], True)
            done, first = done.iloc[n:], False
        if len(done):
            k = done["short"].to_numpy()
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            length = np.diff(np.append(starts, len(k)))
            done = done[np.repeat(length > 1, length)]
            if len(done):
                docs = done.groupby("short", sort=False)["doc_id"].transform("nunique")
                done = done[docs > 1]
                longer = done.groupby(["short", "long"], sort=False)["doc_id"].transform("nunique")
                yield done.assign(core=(done["long"] != 0) & (longer > 1), sure=True, edge=False)
    if held is not None and len(held):
        yield told(held, True)


def _inside(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """One row per match; inside: two cores of the document cover whatever
    the windows that chose the match's place could add."""
    for pdf in batches:
        parts = []
        for doc_id, text_hash, found in zip(pdf["doc_id"], pdf["text_hash"], pdf["found"], strict=True):
            short, pos, low, high, core = (np.array([x[c] for x in found], t) for c, t in (
                ("short", np.int64), ("pos", np.int32), ("low", np.int32), ("high", np.int32), ("core", bool)))
            at = np.sort(pos[core])
            before = np.append(-least - 1, at)[np.searchsorted(at, low, side="right")]
            parts.append(((doc_id, text_hash), short, pos, low, high, core, core & (before >= pos - least)))
        if parts:
            yield _frame(("short", "pos", "low", "high", "core", "inside"), parts)


def _extend(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The windows of ``least`` words that start where the matches' places
    were chosen."""
    words = WordHashes()
    for pdf in batches:
        parts = []
        for doc_id, text_hash, text, found in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"], pdf["found"], strict=True):
            h = word_hashes(text, words)
            starts = {s for x in found for s in range(int(x["low"]), int(x["high"]) + 1)}
            at = np.array(sorted(s for s in starts if s + least <= len(h)), np.int64)
            if len(at):
                parts.append(((doc_id, text_hash), Prefix(h).runs(least, at).astype(np.int64), at.astype(np.int32)))
        if parts:
            yield _frame(("window", "pos"), parts)


def repeated_windows(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, pos): word windows of ``least`` words that stand in
    another document, too; of overlapping ones inside a long match only some,
    which cover the same words."""
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "short long, long long, doc_id long, text_hash long, pos int, low int, high int"
    suffixes = store(texts.mapInPandas(lambda b: _suffixes(b, least), schema), "suffixes")
    # Sorted over the cluster; equal prefixes of a hot passage spread over tasks.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["short", "long", "doc_id", "text_hash", "pos"]
    array = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    near = store(array.mapInPandas(_neighbours, schema + ", core boolean, sure boolean, edge boolean"), "neighbours")
    edges = near.filter("edge").groupBy("short").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("short")
    open_ = near.filter("edge AND NOT sure").join(small(store(edges, "edges")), "short", "left_semi")
    sure = near.filter("sure").unionByName(open_.select(*near.columns))
    doc = ["doc_id", "text_hash"]
    per_doc = sure.groupBy(*doc).agg(F.collect_set(F.struct("short", "pos", "low", "high", "core")).alias("found"))
    # Where cores cover the words of every document of a run of suffixes, its
    # windows need not be compared.
    matches = store(per_doc.mapInPandas(lambda b: _inside(b, least), "doc_id long, text_hash long, short long, pos int, low int, high int, "
                                        "core boolean, inside boolean"), "matches")
    open_runs = matches.groupBy("short").agg(F.min("inside").alias("inside")).filter("NOT inside").select("short")
    open_runs = small(store(open_runs, "open-runs"))  # stored: a join of plain exchanges can be split where a run is hot
    per_doc = store(matches.join(open_runs, "short", "left_semi").groupBy(*doc)
                    .agg(F.collect_list(F.struct("low", "high")).alias("found")), "open-matches")
    ids = small(per_doc.select(*doc))
    held = texts.join(ids, doc, "left_semi").dropDuplicates(doc).join(per_doc, doc)
    windows = store(held.mapInPandas(lambda b: _extend(b, least), "window long, doc_id long, text_hash long, pos int"), "windows")
    again = windows.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("window")
    again = small(store(again, "again"))
    extended = windows.join(again, "window", "left_semi").select("doc_id", "text_hash", "pos")
    cores = matches.filter("core").select("doc_id", "text_hash", "pos")
    return cores.union(extended)


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a passage of ``least`` words or more
    with another one: doc_id, spans (start, end in words, end exclusive, in
    order), n_repeated (words in them).

    Words are blank-delimited and compared after lower-casing A-Z. Documents
    without such a passage, null and empty texts and rows with a null id have
    no row. Repeats within one document alone, or among rows of one id, don't
    count; texts that share an id get a row each. Texts of any length are
    searched whole; an empty table gives no rows. Extra columns are ignored.
    """
    starts = repeated_windows(docs, least, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Spans from the starts: a start opens one where the start before it is over ``least`` words back.
    opens = F.filter("at", lambda p, i: (i == 0) | (p - F.get("at", i - 1) > least))
    closes = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1) - p > least, F.lit(True)))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), (b + least).alias("end")))
    out = starts.select("doc_id", spans.alias("spans"))
    return out.select("doc_id", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated"))
