"""Guarded status sequences: what happens when refused commands change
nothing (E8, E12).

Whether a command is accepted depends on the status at that point, and so on
the commands accepted before. But a command is a function from status to
status, and functions compose associatively: over a handful of statuses such a
function is a small table, packed into one number. So an order's commands are
cut into chunks, each chunk's functions are composed, the chunks' functions
are composed in turn, and every command then knows the status that it met. An
order with any number of commands is dealt to as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.changes import _command_status, number_within
from stockflow.operators.search import ORDER_STATUSES, allowed_commands
from stockflow.stored import store

CHUNK = 1_024   # functions composed at a time, by two levels
_BITS = 4       # of a packed function, per status


def packed(targets: Sequence[Column]) -> Column:
    """A function as one number: status index ``s`` goes to ``targets[s]``."""
    return reduce(Column.bitwiseOR, [F.shiftleft(t.cast("long"), _BITS * s) for s, t in enumerate(targets)])


def applied(fn: Column, status: Column) -> Column:
    """The status index that ``status`` goes to."""
    return F.call_function("shiftright", fn, (status * _BITS).cast("int")).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def composed(first: Column, then: Column, statuses: int) -> Column:
    """``first`` and then ``then``, as one packed function."""
    return packed([applied(then, applied(first, F.lit(s))) for s in range(statuses)])


def _chunked(rows: DataFrame, keys: list[str], chunk: Column, statuses: int) -> DataFrame:
    """One row per key and chunk: its ``items`` (at, fn, ...) in order, the
    composition of all of them, and for each that of the items before it."""
    same = sum(s << (_BITS * s) for s in range(statuses))
    start = F.struct(F.lit(same).cast("long").alias("all"), F.array().cast("array<bigint>").alias("before"))
    items = F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])))
    return (rows.groupBy(*keys, chunk.alias("_chunk")).agg(items.alias("items"))
            .withColumn("run", F.aggregate("items", start, lambda acc, item: F.struct(
                composed(acc["all"], item["fn"], statuses).alias("all"),
                F.concat(acc["before"], F.array(acc["all"])).alias("before")))))


def _opened(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The items of chunks again, each with ``before``."""
    zipped = F.transform("items", lambda item, i: F.struct(item.alias("item"), F.get("run.before", i).alias("before")))
    return cut.select(*keys, "_chunk", F.explode(zipped).alias("_e")).select(*keys, "_chunk", "_e.item", "_e.before")


def _after(outer: DataFrame, inner: DataFrame, keys: list[str], statuses: int) -> DataFrame:
    """``inner`` with its ``before`` preceded by its chunk's own ``before`` in
    ``outer`` (where the chunk has one)."""
    o = outer.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("item.at").alias("_o_at"), F.col("before").alias("_o_before"))
    met = inner.join(o, [inner[k] == o[f"_o_{k}"] for k in keys] + [inner["_chunk"] == o["_o_at"]], "left")
    whole = F.when(F.col("_o_before").isNull(), F.col("before")).otherwise(composed(F.col("_o_before"), F.col("before"), statuses))
    return met.select(*keys, "item", whole.alias("before"))


def prefix_compositions(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Column, out: str, statuses: int) -> DataFrame:
    """``df`` plus ``out``: the composition of the functions ``fn`` of the
    key's rows before this one, in ``order`` (which must be total). Rows with
    a null key are left out.

    Rows are numbered within their key without a task holding the key. Chunks
    of ``CHUNK`` rows are composed, then chunks of chunks; only keys with more
    than one chunk take part in that. The last level holds one function per
    ``CHUNK`` squared rows of a key.
    """
    keys = list(keys)
    numbered = number_within(df.withColumn("_fn", fn), keys, order, "_at").dropna(subset=keys)
    rows = numbered.select(*keys, (F.col("_at") - 1).alias("at"), F.col("_fn").alias("fn"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    cut = store(_chunked(rows, keys, F.floor(F.col("at") / CHUNK).cast("long"), statuses), "chunks")
    long = cut.filter(F.col("_chunk") == 1).select(*keys)
    totals = cut.join(long, keys, "left_semi").select(*keys, F.col("_chunk").alias("at"), F.col("run.all").alias("fn"))
    upper = _chunked(totals, keys, F.floor(F.col("at") / CHUNK).cast("long"), statuses)
    top = _chunked(upper.select(*keys, F.col("_chunk").alias("at"), F.col("run.all").alias("fn")), keys, F.lit(0).cast("long"), statuses)
    chunks = _after(_opened(top, keys), _opened(upper, keys), keys, statuses)
    return _after(chunks, _opened(cut, keys), keys, statuses).select("item.row.*", F.col("before").alias(out))


def guarded_statuses(orders: DataFrame, commands: DataFrame, kind: str) -> DataFrame:
    """commands(order_id, seq, command[, status]) plus old_status, new_status
    and accepted: in ``seq`` order, a command that the rules of ``kind`` do not
    offer from the order's status at that point is refused and changes nothing
    (new_status = old_status). A given ``status`` (of a delivery or receipt)
    is where the command leads.

    Orders without a status, and orders that are not in ``orders``, start as
    'Draft'. From a status that the rules don't know, only 'cancel' is
    accepted. A command that leads nowhere known is refused.
    """
    names = ORDER_STATUSES[kind]
    n = len(names) + 1                       # and one index for any other status
    position = {s: i for i, s in enumerate(names)}
    target = _command_status(F.col("command"))
    if "status" in commands.columns:
        target = F.coalesce(F.col("status"), target)
    goes_to = _index(target, position)
    offered = set(allowed_commands(kind)) | {(None, "cancel")}
    steps = [F.when(F.col("command").isin(*[c for s, c in offered if s == name]) & (goes_to < n - 1), goes_to).otherwise(F.lit(i))
             if any(s == name for s, _ in offered) else F.lit(i) for i, name in enumerate([*names, None])]
    known = commands.filter(F.col("order_id").isNotNull())
    met = prefix_compositions(known.withColumn("_step", packed(steps)), ["order_id"], ["seq"], F.col("_step"), "_before", n)
    start = orders.select(F.col("id").alias("order_id"), F.coalesce("status", F.lit("Draft")).alias("_start"))
    rows = met.join(start, "order_id", "left").withColumn("_start", F.coalesce("_start", F.lit("Draft")))
    old = applied(F.col("_before"), _index(F.col("_start"), position))
    rows = rows.withColumn("_old", old).withColumn("_new", applied(F.col("_step"), F.col("_old")))
    label = F.array(*[F.lit(s) for s in names])

    def named(i: Column) -> Column:
        return F.when(i < n - 1, F.get(label, i)).otherwise(F.col("_start"))

    accepted = F.coalesce(reduce(Column.__or__, [
        (F.col("_old") == i) & F.col("command").isin(*[c for s, c in offered if s == name]) for i, name in enumerate([*names, None])
        if any(s == name for s, _ in offered)]) & (goes_to < n - 1), F.lit(False))
    kept = [c for c in commands.columns if c not in ("old_status", "new_status", "accepted")]
    return rows.select(*kept, named(F.col("_old")).alias("old_status"), named(F.col("_new")).alias("new_status"), accepted.alias("accepted"))


def _index(status: Column, position: dict[str, int]) -> Column:
    e = F.lit(len(position))
    for name, i in position.items():
        e = F.when(status == name, F.lit(i)).otherwise(e)
    return e


def final_guarded_status(orders: DataFrame, guarded: DataFrame) -> DataFrame:
    """(order_id, status, accepted, refused): every order's status after the
    guarded commands, with their numbers."""
    per = guarded.groupBy("order_id").agg(
        F.max_by("new_status", "seq").alias("_last"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    return (orders.select(F.col("id").alias("order_id"), F.col("status").alias("_start")).join(per, "order_id", "left")
            .select("order_id", F.coalesce("_last", "_start", F.lit("Draft")).alias("status"),
                    F.coalesce("accepted", F.lit(0)).cast("bigint").alias("accepted"), F.coalesce("refused", F.lit(0)).cast("bigint").alias("refused")))
