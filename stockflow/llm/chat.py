"""Chat formatting of reply trees.

Messages form trees. Root-to-leaf paths come from self-joins that double
the number of steps they look up, branches are ranked by score, and each
chosen path is written as one conversation with its loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import store

# The marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """``text`` without any ``<|``; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) under the loss
    mask: the escaped text of each assistant turn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        role_end = formatted.index("\n", at)
        text_end = formatted.index(END, role_end + 1)
        out.append((unescape(formatted[at + len(START):role_end]), unescape(formatted[role_end + 1:text_end])))
        at = text_end + len(END)
    return out


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of conversations whose
    turns answer each other in a row. Ties in ``turn`` go by role and text;
    null turns come first; null role and text count as empty. Repeated rows are
    turns of their own, a null conv_id is a conversation like others, texts may
    be of any length, and an empty table gives no messages. Other columns are
    not read."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"),
                                text("role").alias("role"), text("text").alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b["_tree"]) & (a[left] == b[right])


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node): the nodes of each tree's ``top`` best
    root-to-leaf paths, depth 0 at the leaf.

    A path's score is the mean score of its messages (null: 0); ties go to the
    lesser leaf. A message whose parent is missing is a root; one that is its
    own ancestor is in no path. ``node`` identifies a message within its tree.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    linked = nodes.join(known, _same(nodes, known, "parent", "_node"), "left")
    # jumps[k]: the nodes over 2^k steps below a root, their ancestor 2^k steps up, and
    # what those steps sum up to. A node whose steps passed the root is done.
    first = store(linked.select("tree", "node", F.col("_node").alias("up"), F.lit(1).cast("long").alias("steps"), "score"), "jump0")
    live, done = first.filter("up IS NOT NULL"), first.filter("up IS NULL")
    jumps = []
    rounds = nodes.count().bit_length()  # no path is longer; what is left runs in a circle
    while len(jumps) < rounds and not live.isEmpty():
        jumps.append(live)
        to = live.union(done).select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"),
                                     F.col("steps").alias("_steps"), F.col("score").alias("_score"))
        twice = store(live.join(to, _same(live, to, "up", "_node")).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("score") + F.col("_score")).alias("score")), f"jump{len(jumps)}")
        live, done = twice.filter("up IS NOT NULL"), done.union(twice.filter("up IS NULL"))
    parents = nodes.filter("parent IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("parent").alias("_node")).distinct()
    leaves = done.join(parents, _same(done, parents, "node", "_node"), "left_anti")
    by = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    paths = store(chosen.select("tree", F.col("node").alias("leaf"), "rank", F.lit(0).cast("long").alias("depth"), "node"), "leaves")
    for k, jump in enumerate(jumps):
        to = jump.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        higher = paths.join(to, _same(paths, to, "node", "_node")).select(
            "tree", "leaf", "rank", (F.col("depth") + (1 << k)).alias("depth"), F.col("_up").alias("node"))
        paths = store(paths.union(higher), f"paths{k}")
    return paths


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): each chosen path of
    ``messages`` (tree, node, parent, role, text, score) as one conversation.

    loss_spans are [start, end) in code points of ``formatted``. Null role and
    text count as empty. A path is one output row and so is held by one task.
    """
    paths = best_paths(messages, top)
    said = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"),
                           *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = paths.join(said, _same(paths, said, "node", "_node"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("place"), "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:long,end:long>>")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in some]
            yield pd.DataFrame({"formatted": [f for f, _ in made],
                                "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in made]})

    return turns.select("tree", "leaf", "rank", write("turns").alias("w")).select("tree", "leaf", "rank", "w.*")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: tree,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    @F.pandas_udf(fields)
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, loss in zip(texts, spans, strict=True):
            turns = parse_turns(text)
            under = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
            out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    return formatted.select("tree", read("formatted", "loss_spans").alias("d")).select("tree", "d.*")
