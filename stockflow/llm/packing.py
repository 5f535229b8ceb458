"""Token ids packed into rows of fixed length.

Each task encodes its documents and packs them, a bounded number of tokens
at a time, by best-fit decreasing: the longest segment first, into the
fullest row that still holds it. A segment tree over free capacities finds
that row. Documents longer than a row are split; no token is lost.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.tokens import PieceIds, load, pieces_of, specials, tokenizer_path

GROUP_TOKENS = 4_000_000  # tokens that a task packs at once
PACKED = ("pack_id string, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, doc_offsets array<long>, doc_lengths array<long>")


class FreeRows:
    """Rows by free capacity, with a segment tree that finds the least
    capacity of at least ``need`` that some row has, in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.base)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, free: int, step: int) -> None:
        node = self.base + free
        while node:
            self.some[node] += step
            node >>= 1

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a fullest row that holds ``need``, taken out."""
        node = self.base + need
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        free = node - self.base
        self._count(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each from 1 to ``capacity``)."""
    free_rows, rows = FreeRows(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free, row = free_rows.take(lengths[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if free > lengths[i]:
            free_rows.add(free - lengths[i], row)
    return rows


def pack_tokens(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = 2048, pad_id: int = 0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``capacity`` ids packed from all documents of ``docs``.

    input_ids: little-endian ids, 2 bytes each (4 if the vocabulary needs it),
    padded with ``pad_id`` after ``n_tokens``; stacked, they are an id matrix.
    cu_seqlens: ends of the segments, from 0. position_resets: where positions
    restart at 0, the start of each segment. doc_ids, doc_offsets, doc_lengths:
    per segment its document, its first token there and the document's tokens.

    Ids are those that the tokenizers library gives for the file at ``path``;
    ``ranks`` names the same vocabulary as ranks, to encode faster (both by
    default byte_bpe_50k). Null and empty texts have no tokens and so no segment;
    an empty table gives no rows. Repeated rows are packed each. A null doc_id
    stays null. Extra columns are ignored. Which documents share a row, and
    ``pack_id``, depend on how the input is partitioned; every token is in
    exactly one row however that is.
    """
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")

    # Found here, so that workers load the library's tokenizer only where a text needs it.
    code, special = "I" if load(path).get_vocab_size() > 1 << 16 else "H", specials(path)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        size, part, group = array(code).itemsize, TaskContext.get().partitionId(), 0
        pieces = PieceIds(path, ranks, code)
        packed = lambda ids: array(code, ids).tobytes()
        held, tokens = [], 0  # (doc_id, offset, doc tokens, ids)

        def rows() -> pd.DataFrame:
            out = []
            for k, row in enumerate(best_fit_decreasing([len(s[3]) // size for s in held], capacity)):
                segments = [held[i] for i in row]
                ends = np.cumsum([0] + [len(s[3]) // size for s in segments]).tolist()
                ids = b"".join(s[3] for s in segments) + packed([pad_id]) * (capacity - ends[-1])
                out.append((f"{part}-{group}-{k}", ids, ends[-1], ends, ends[:-1], [s[0] for s in segments],
                            [s[1] for s in segments], [s[2] for s in segments]))
            return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                if not text:
                    continue
                parts = pieces_of(text, special)
                if parts is None:
                    marked = any(s in text for s in special)
                    ids = packed(load(path).encode(text, add_special_tokens=False).ids if marked else pieces.ids_of(text))
                else:
                    ids = packed(pieces.ids_of(parts[0])) + b"".join(map(pieces.__getitem__, parts[1:]))
                n = len(ids) // size
                who = None if doc_id is None or doc_id != doc_id else int(doc_id)
                for at in range(0, n, capacity):
                    held.append((who, at, n, ids[at * size:(at + capacity) * size]))
                    tokens += capacity if at + capacity <= n else n - at
                    if tokens >= GROUP_TOKENS:
                        yield rows()
                        held, tokens, group = [], 0, group + 1
        if held:
            yield rows()

    # Ids as text: pandas would turn a column with a null into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(pack, PACKED)


def segments(packed: DataFrame) -> DataFrame:
    """(doc_id, doc_offset, n_doc_tokens, ids) per segment, read back from
    packed rows of 2-byte ids; in order of doc_offset they give the document."""
    one = packed.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets", "doc_lengths")).alias("i", "s"))
    start, end = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return one.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"),
                      F.col("s.doc_lengths").alias("n_doc_tokens"),
                      F.substring("input_ids", 2 * start + 1, 2 * (end - start)).alias("ids"))
