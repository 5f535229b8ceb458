"""Token counts by two-tier lookup, and the cached encoder that packing shares.

A text is cut at single blanks into pieces that a byte-level BPE with the
usual word pattern encodes independently: a pre-token starts at a blank or
inside one piece, never across the blank. Texts where that does not hold
(runs of blanks, or special strings inside) go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import most_frequent, store

CACHE_PIECES = 400_000   # entries of a worker's cache; emptied when full
TASK_PIECES = 20_000     # frequent pieces that a task reports
COUNTED_PIECES = 300_000  # pieces that a task counts at once before rare ones are let go
FREQUENT_PIECES = 50_000  # entries of the broadcast table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer, once per worker process, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def piece_encoder(path: str, ranks: str | None):
    """A function from a text without special strings to its ids. ``ranks``:
    a file with the same vocabulary as ranks, encoded several times faster."""
    if ranks is None:
        return lambda text: load(path).encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def pieces_of(text: str, special: tuple[str, ...]) -> list[str] | None:
    """Independent pieces of ``text``: the first as it is, the others standing
    for a blank and what follows. None: the text must be encoded whole."""
    parts = text.split(" ")
    if "" in parts[1:] or any(s in text for s in special):
        return None
    return parts


class PieceCache(dict):
    """piece -> what ``value`` makes of its ids; bounded, per worker."""

    def __init__(self, path: str, value, base: dict | None = None):
        super().__init__()
        self.path, self.value, self.base = path, value, base or {}
        self.update(self.base)

    def encode(self, texts: list[str]) -> list:
        found = load(self.path).encode_batch_fast(texts, add_special_tokens=False)
        return [self.value(x.ids) for x in found]

    def fill(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self]
        if len(self) + len(missing) > CACHE_PIECES + len(self.base):
            self.clear()
            self.update(self.base)
            missing = [p for p in pieces if p not in self]
        for at in range(0, len(missing), 4096):
            some = missing[at:at + 4096]
            self.update(zip(some, self.encode([" " + p for p in some]), strict=True))


class PieceIds(dict):
    """piece -> its ids as bytes; encoded when first met, bounded, per worker."""

    def __init__(self, path: str, ranks: str | None, typecode: str):
        super().__init__()
        self.ids_of, self.typecode = piece_encoder(path, ranks), typecode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = array(self.typecode, self.ids_of(" " + piece)).tobytes()
        return ids


def frequent_pieces(docs: DataFrame, text_col: str = "text", rows: int = FREQUENT_PIECES) -> DataFrame:
    """(piece, n): the most frequent pieces of all texts, at most ``rows``.

    Tasks count the pieces of all their texts and report their most frequent
    ones; only these bounded reports are shuffled. The counts of pieces that
    some tasks left out are too low, which costs speed, never a count.
    """
    special_of = tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special, seen = specials(special_of), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text and (parts := pieces_of(text, special)):
                    seen.update(parts[1:])
                    if len(seen) > COUNTED_PIECES:
                        seen = Counter(dict(seen.most_common(COUNTED_PIECES // 3)))
        top = seen.most_common(TASK_PIECES)
        yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]}).astype({"piece": object, "n": "int64"})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "piece string, n long")
    return most_frequent(store(counted.groupBy("piece").agg(F.sum("n").alias("n")), "pieces"), rows)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    First tier: a broadcast table of the lengths of frequent pieces (at most
    ``FREQUENT_PIECES``). Second tier: pieces it lacks are encoded by the
    library and kept in the worker's bounded cache. No piece is shuffled. Null
    and empty texts have no bytes and no tokens; texts of any length are
    counted whole. Repeated rows each get their row; an empty table gives none.
    Extra columns are ignored.
    """
    path = path or tokenizer_path()
    top = [r.piece for r in frequent_pieces(docs, text_col).collect()]  # bounded
    first = PieceCache(path, len)
    table = dict(zip(top, first.encode([" " + p for p in top]), strict=True)) if top else {}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths, special = PieceCache(path, len, shared.value), specials(path)
        for texts in batches:
            cut = [pieces_of(t, special) if t else [""] for t in texts]
            for at in range(0, len(cut), 256):  # fill for some texts at a time: the cache stays bounded
                some = cut[at:at + 256]
                wanted = set().union(*(p[1:] for p in some if p))
                lengths.fill(wanted)
                whole = lengths.encode([texts.iloc[at + i] if p is None else p[0] for i, p in enumerate(some)])
                cut[at:at + 256] = [n if p is None else n + sum(map(lengths.__getitem__, p[1:])) for n, p in zip(whole, some, strict=True)]
            yield pd.Series(cut, dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
