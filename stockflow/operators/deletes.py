"""Deletes with cascades and refusals (H7), over the graph of foreign keys.

Requested rows and what cascades from them are candidates. A candidate that a
row outside of them refers to, by a key that restricts, survives, and what
survives makes more survive: the rows it refers to, the parent that would
have deleted it, and the children that only went with it. These marks spread
along references in rounds until none is new. Rounds follow the longest chain
of references among candidates; each joins the newest marks only. Tables that
no mark can reach, by their keys alone (often the largest: lines, ledgers,
logs), take no part in the rounds: what they delete goes, and only rows of
theirs that are no candidates hold anything back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.reach import reached
from stockflow.stored import store

Key = tuple[str, str, str]  # child table, column, parent table


NODE, TO = ["table_name", "key"], ["to_table", "to_key"]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _nodes(table: str, rows: DataFrame) -> list[Column]:
    return [F.lit(table).alias("table_name"), rows["id"].cast("string").alias("key")]


def references(tables: Mapping[str, DataFrame], keys: Sequence[Key]) -> DataFrame | None:
    """(table_name, key, fk, to_table, to_key): every non-null reference, each
    table read once for all its keys."""
    frames = []
    for t in dict.fromkeys(k[0] for k in keys):
        rows = tables[t]
        refs = F.array(*[F.struct(F.lit(f"{t}.{col}").alias("fk"), F.lit(p).alias("to_table"), rows[col].cast("string").alias("to_key"))
                         for c, col, p in keys if c == t])
        frames.append(rows.select(*_nodes(t, rows), F.inline(F.filter(refs, lambda r: r["to_key"].isNotNull()))))
    return _union(frames) if frames else None


def staying_tables(restrict: Sequence[Key], cascade: Sequence[Key]) -> set[str]:
    """Tables whose candidates may have to stay: those that a restricting key
    leads to, and those that a mark reaches from there."""
    steps = {(c, p) for c, _, p in [*restrict, *cascade]} | {(p, c) for c, _, p in cascade}
    found = {p for _, _, p in restrict}
    while more := {b for a, b in steps if a in found} - found:
        found |= more
    return found


def longest_path(cascade: Sequence[Key], asked: Sequence[str]) -> int | None:
    """How many cascades can follow each other from the tables ``asked``; None
    where tables cascade in a circle."""
    level, depth = set(asked), 0
    while level := {c for c, _, p in cascade if p in level}:
        depth += 1
        if depth > len(cascade):
            return None
    return depth


def delete_outcomes(tables: Mapping[str, DataFrame], requests: Mapping[str, DataFrame], cascade: Sequence[Key],
                    foreign_keys: Sequence[Key]) -> DataFrame:
    """(table_name, key, outcome, blocked_by) for every row that the deletes
    of ``requests`` (table -> rows with ``id``) would remove, taken together:

    - 'deleted': requested, and gone;
    - 'cascaded': gone with its parent;
    - 'refused': requested, but it has to stay;
    - 'kept': not requested itself, and its parent has to stay.

    ``blocked_by`` is the first (by name) 'table.column' by which a row that
    stays refers to it; null where none does (its parent or child stays).
    ``foreign_keys`` restrict, but for those in ``cascade``. Rows that only
    refer to each other go together. Null references hold nothing back;
    requests for rows that don't exist are ignored, repeated ones are one.
    Keys whose tables or columns are not in ``tables`` are left out; ids are
    compared as text, and rows with a null id take no part.
    """
    there = lambda k: k[0] in tables and k[2] in tables and k[1] in tables[k[0]].columns
    cascades = [k for k in cascade if there(k)]
    restricts = [k for k in foreign_keys if there(k) and k not in cascade]
    may_stay = staying_tables(restricts, cascades)
    down, up = references(tables, cascades), references(tables, restricts)
    asked = []
    for t, ids in requests.items():
        if t in tables:
            rows = tables[t].select("id").filter("id is not null").distinct()
            asked.append(rows.join(ids.select("id"), "id", "left_semi").select(*_nodes(t, rows)))
    asked = store(_union(asked), "requested")
    to_children = None
    if down is not None:
        to_children = down.select(F.col("to_table").alias("table_name"), F.col("to_key").alias("key"), F.col("table_name").alias("to_table"), F.col("key").alias("to_key"))
    going = reached(asked, to_children, NODE, TO, longest_path(cascades, [t for t in requests if t in tables]))

    # What rounds and references meet of the candidates: few, where large tables cannot stay.
    stayable = going.filter(F.col("table_name").isin(*may_stay)) if may_stay else going.limit(0)

    def among(edges: DataFrame) -> DataFrame:
        """Edges that lead to candidates, with whether they come from one."""
        at = stayable.select(F.col("table_name").alias("to_table"), F.col("key").alias("to_key"))
        return (edges.join(at, TO, "left_semi")
                .join(stayable.withColumn("going", F.lit(True)), NODE, "left"))

    spread, seeds = [], asked.limit(0)
    refs = None
    if up is not None:
        never = [t for t in dict.fromkeys(k[0] for k in restricts) if t not in may_stay]
        inner = references(tables, [k for k in restricts if k[0] in may_stay])
        found = [among(inner).select(*NODE, "to_table", "to_key", "fk", F.coalesce("going", F.lit(False)).alias("going"))] if inner is not None else []
        if never:  # rows of the others hold what they refer to if they are no candidates: one row per key and target
            outer = references(tables, [k for k in restricts if k[0] in never]).join(
                going.filter(F.col("table_name").isin(*never)), NODE, "left_anti")
            outer = outer.groupBy(*TO).agg(F.min("fk").alias("fk")).join(
                stayable.select(F.col("table_name").alias("to_table"), F.col("key").alias("to_key")), TO, "left_semi")
            found.append(outer.select(F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("key"), *TO, "fk", F.lit(False).alias("going")))
        refs = store(_union(found), "references")
        seeds = refs.filter(~F.col("going")).select(F.col("to_table").alias("table_name"), F.col("to_key").alias("key"))
        spread.append(refs.filter("going").select(*NODE, "to_table", "to_key"))
    if down is not None:
        kin = references(tables, [k for k in cascades if k[0] in may_stay])
        kin = down.limit(0) if kin is None else kin
        family = store(among(kin).filter("going").select(*NODE, "to_table", "to_key"), "family")
        spread.append(family)  # a child that stays keeps its parent
        kept = family.join(asked, NODE, "left_anti")
        spread.append(kept.select(F.col("to_table").alias("table_name"), F.col("to_key").alias("key"), F.col("table_name").alias("to_table"), F.col("key").alias("to_key")))
    stays = reached(seeds, store(_union(spread).distinct(), "spread") if spread else None, NODE, TO)

    rows = (going.join(asked.withColumn("_asked", F.lit(True)), NODE, "left").join(stays.withColumn("_stays", F.lit(True)), NODE, "left"))
    if refs is not None:
        blocks = (refs.join(stays.withColumn("_holds", F.lit(True)), NODE, "left").filter(~F.col("going") | F.coalesce("_holds", F.lit(False)))
                  .groupBy(F.col("to_table").alias("table_name"), F.col("to_key").alias("key")).agg(F.min("fk").alias("blocked_by")))
        rows = rows.join(blocks, NODE, "left")
    else:
        rows = rows.withColumn("blocked_by", F.lit(None).cast("string"))
    outcome = (F.when(F.col("_asked") & F.col("_stays"), "refused").when(F.col("_stays"), "kept")
                .when(F.col("_asked"), "deleted").otherwise("cascaded"))
    return rows.select(*NODE, outcome.alias("outcome"), "blocked_by")
