"""Change feeds: compaction, patches, status sequences, numbering and the
audit trail (E7-E10, E12, A7, A8, F5, D18).

A feed is an append-only DataFrame with a key, a total order ``seq`` and an
``op`` of create / update / delete. Final state is computed with one
aggregation per key (partial aggregation map-side, so a hot key does not
gather its rows in one task); only the per-row reject test needs an ordered
scan, which runs through the piecewise prefix scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.scalars import null_to_empty, reference_code
from stockflow.operators.scan import HOT_ROWS, prefix_scan, prefix_scans, split_hot
from stockflow.stored import store

_MIN_SEQ = -(2 ** 62)


def _with_base(feed: DataFrame, base: DataFrame | None, key: str) -> DataFrame:
    if base is None:
        return feed
    # Base rows behave as creates that precede every feed row.
    cols = [c for c in feed.columns if c not in (key, "seq", "op")]
    b = base.select(key, F.lit(_MIN_SEQ).cast(feed.schema["seq"].dataType).alias("seq"),
                    F.lit("create").alias("op"),
                    *[(F.col(c) if c in base.columns else F.lit(None)).cast(feed.schema[c].dataType).alias(c)
                      for c in cols])
    return b.unionByName(feed)


def compact_changes(feed: DataFrame, key: str, keep_cols: Sequence[str] = (),
                    overlay_cols: Sequence[str] = (), base: DataFrame | None = None) -> DataFrame:
    """Latest state per key of a create / update / delete feed.

    A key is alive when its last create (or base row) comes after its last
    delete. A create starts a fresh record; updates after it apply in seq
    order. ``overlay_cols`` take the value of the latest create/update even
    when null (E7a); ``keep_cols`` take the latest non-null value (E7b style,
    a null means 'not sent'). Updates and deletes of a key that is not
    alive at that point are rejects (see ``feed_rejects``) and cannot affect
    the final state of a live key.
    """
    return state_of(change_summary(_with_base(feed, base, key), key, keep_cols, overlay_cols), key, keep_cols, overlay_cols)


def change_summary(feed: DataFrame, key: str, keep_cols: Sequence[str] = (), overlay_cols: Sequence[str] = ()) -> DataFrame:
    """E7, mergeable: one row per key with what decides its state: the last
    create, delete and write, and per column the last value with its seq.
    Deleted keys keep a row, so that summaries merge in any order."""
    op = F.col("op")
    write = op.isin("create", "update")
    aggs = [F.max(F.when(op == "create", F.col("seq"))).alias("last_create"),
            F.max(F.when(op == "delete", F.col("seq"))).alias("last_delete"),
            F.max(F.when(write, F.col("seq"))).alias("last_seq")]
    for c in keep_cols:
        aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"v_{c}"),
                 F.max(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"s_{c}")]
    for c in overlay_cols:
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")), F.when(write, F.col("seq"))).alias(f"o_{c}"))
    return feed.groupBy(key).agg(*aggs)


def merge_summaries(rows: DataFrame, key: str, keep_cols: Sequence[str] = (), overlay_cols: Sequence[str] = ()) -> DataFrame:
    """Summaries of any parts of a feed, put together: one row per key. Parts
    may come in any order and more than once."""
    aggs = [F.max(c).alias(c) for c in ("last_create", "last_delete", "last_seq")]
    for c in keep_cols:
        aggs += [F.max_by(f"v_{c}", f"s_{c}").alias(f"v_{c}"), F.max(f"s_{c}").alias(f"s_{c}")]
    aggs += [F.max_by(f"o_{c}", "last_seq").alias(f"o_{c}") for c in overlay_cols]
    return rows.groupBy(key).agg(*aggs)


def state_of(summary: DataFrame, key: str, keep_cols: Sequence[str] = (), overlay_cols: Sequence[str] = ()) -> DataFrame:
    """The records that a summary leaves alive (see ``compact_changes``)."""
    alive = F.col("last_create").isNotNull() & (
        F.col("last_delete").isNull() | (F.col("last_create") > F.col("last_delete")))
    out = [F.col(key)]
    for c in keep_cols:
        out.append(F.when(F.col(f"s_{c}") >= F.col("last_create"), F.col(f"v_{c}")).alias(c))
    for c in overlay_cols:
        out.append(F.col(f"o_{c}.v").alias(c))
    out.append(F.when(F.col("last_seq") > F.lit(_MIN_SEQ), F.col("last_seq")).alias("last_seq"))
    return summary.filter(alive).select(*out)


def feed_rejects(feed: DataFrame, key: str, base: DataFrame | None = None) -> DataFrame:
    """E7 rejects: updates and deletes of a key that does not exist at that
    point (the reference answers 404 and changes nothing)."""
    rows = _with_base(feed.select(key, "seq", "op"), base, key) if base is not None else feed.select(key, "seq", "op")
    life = F.when(F.col("op").isin("create", "delete"), F.col("op"))
    scanned = prefix_scan(rows, [key], ["seq"], life, "last", "_prev_life", inclusive=False)
    return (scanned.filter(F.col("op").isin("update", "delete")
                           & ~F.coalesce(F.col("_prev_life") == "create", F.lit(False)))
            .filter(F.col("seq") > F.lit(_MIN_SEQ))
            .select(key, "seq", "op", F.lit("not found").alias("error")))


def overlay_patch(base: DataFrame, patches: DataFrame, key: str,
                  protected: Sequence[str] = ("reference",)) -> DataFrame:
    """patches(key, seq, patch map<string,string>) applied in seq order;
    a field present in a patch overwrites, null included; absent fields and
    protected fields (and the key) keep their value. Text that does not fit
    the column's type is read as null (try_cast; ANSI casts would fail)."""
    fields = [c for c in base.columns if c != key and c not in protected]
    p = F.col("patch")
    g = patches.groupBy(key).agg(*[
        F.max_by(F.struct(p[f].alias("v")), F.when(F.map_contains_key(p, f), F.col("seq"))).alias(f"_p_{f}")
        for f in fields])
    j = base.join(g, key, "left")
    return j.select(*[
        F.col(c) if c == key or c in protected else
        F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v").try_cast(base.schema[c].dataType))
         .otherwise(F.col(c)).alias(c)
        for c in base.columns])


def keep_patch(base: DataFrame, patches: DataFrame, key: str,
               protected: Sequence[str] = ("reference",)) -> DataFrame:
    """A patched value replaces the old one only when it is non-empty
    and not zero (`new || old`); otherwise the old value stays."""
    fields = [c for c in base.columns if c != key and c not in protected]
    p = F.col("patch")

    def truthy(f: str) -> Column:
        v = p[f]
        return v.isNotNull() & (v != "") & ~F.coalesce(v.try_cast("double") == 0, F.lit(False)) & (v != "false")

    g = patches.groupBy(key).agg(*[
        F.max_by(p[f], F.when(truthy(f), F.col("seq"))).alias(f"_p_{f}") for f in fields])
    j = base.join(g, key, "left")
    return j.select(*[
        F.col(c) if c == key or c in protected else
        F.coalesce(F.col(f"_p_{c}").try_cast(base.schema[c].dataType), F.col(c)).alias(c)
        for c in base.columns])


def replace_children(base: DataFrame, new: DataFrame, parent_key: str) -> DataFrame:
    """Parents present in ``new`` get exactly the new child rows;
    other parents keep theirs. One anti join + union."""
    parents = new.select(parent_key).distinct()
    return base.join(parents, parent_key, "left_anti").unionByName(new)


# Status set by each status command.
COMMAND_STATUS = {"confirm": "Confirmed", "start": "In Progress", "produce": "Done",
                  "cancel": "Cancelled"}


def _command_status(cmd: Column) -> Column:
    e = None
    for c, s in COMMAND_STATUS.items():
        e = F.when(cmd == c, s) if e is None else e.when(cmd == c, s)
    return e


def final_status(orders: DataFrame, commands: DataFrame) -> DataFrame:
    """The status after a sequence of status commands: the last command
    wins (the server does not guard transitions); orders without commands
    keep their status, or 'Draft' when they have none. commands(order_id,
    seq, command[, status]) - a given ``status`` (e.g. from a delivery, D13)
    takes precedence over the command's fixed status."""
    st = _command_status(F.col("command"))
    if "status" in commands.columns:
        st = F.coalesce(F.col("status"), st)
    last = (commands.withColumn("_st", st).filter(F.col("_st").isNotNull())
            .groupBy("order_id").agg(F.max_by("_st", "seq").alias("_last")))
    cur = F.col("status") if "status" in orders.columns else F.lit(None)
    return (orders.select(F.col("id").alias("order_id"), cur.alias("_cur")).join(last, "order_id", "left")
            .select("order_id", F.coalesce("_last", "_cur", F.lit("Draft")).alias("status")))


def _with_previous_status(orders: DataFrame, commands: DataFrame) -> DataFrame:
    st = _command_status(F.col("command"))
    if "status" in commands.columns:
        st = F.coalesce(F.col("status"), st)
    c = commands.withColumn("new_status", st).filter(F.col("new_status").isNotNull())
    c = prefix_scan(c, ["order_id"], ["seq"], "new_status", "last", "_prev", inclusive=False)
    cur = orders.select(F.col("id").alias("order_id"), F.col("status").alias("_initial"))
    return (c.join(cur, "order_id", "left")
            .withColumn("old_status", F.coalesce("_prev", "_initial", F.lit("Draft")))
            .drop("_prev", "_initial"))


def audit_rows(orders: DataFrame, commands: DataFrame, module: str, record_type: str,
               style: str = "reference") -> DataFrame:
    """One audit row per status command: module, record, action
    'Updated', field 'status', old and new value (null -> '').

    style 'reference' writes the old value the reference writes: 'Draft' for
    confirm, '' otherwise. style 'real' writes the previous status."""
    c = _with_previous_status(orders, commands) if style == "real" else \
        commands.withColumn("new_status", _command_status(F.col("command"))).filter(F.col("new_status").isNotNull())
    old = (F.col("old_status") if style == "real"
           else F.when(F.col("command") == "confirm", F.lit("Draft")).otherwise(F.lit("")))
    user = F.col("user_name") if "user_name" in c.columns else F.lit(None)
    return c.select(
        "seq", F.lit(module).alias("module"), F.lit(record_type).alias("record_type"),
        F.col("order_id").alias("record_id"), F.coalesce(user, F.lit("System")).alias("user_name"),
        F.lit("Updated").alias("action"), F.lit("status").alias("field_changed"),
        null_to_empty(old).alias("old_value"), null_to_empty(F.col("new_status")).alias("new_value"))


def illegal_transitions(orders: DataFrame, commands: DataFrame, kind: str = "manufacturing") -> DataFrame:
    """Commands the client would not have offered from the status the
    order had at that point, by the rule table of the action menus. That is
    a fixed list of a few rows, so it is broadcast."""
    from stockflow.operators.search import allowed_commands
    c = _with_previous_status(orders, commands)
    allowed = orders.sparkSession.createDataFrame(allowed_commands(kind), "old_status string, command string")
    return (c.join(F.broadcast(allowed), ["old_status", "command"], "left_anti")
            .select("order_id", "seq", "command", "old_status", "new_status"))


def assign_references(df: DataFrame, prefix: str, start: int | DataFrame, order: Sequence[str],
                      num_partitions: int | None = None) -> DataFrame:
    """Number rows in ``order`` from ``start`` (new_id) and give each the
    reference prefix + zero-padded (new_id + 1). ``start`` may be a frame of
    one row (``next_ids``), which is read as a scalar subquery.

    Global numbering without a single-task window: range-partition on the
    order, sort inside partitions, write the rows with their position (so both
    passes see the same ones even if an executor is lost), count per partition,
    prefix offsets over the partition counts (one row per partition,
    broadcast), then offset + position inside the partition.
    """
    tagged = _positioned(df, order, num_partitions)
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    within = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    # A frame of one row becomes a scalar subquery.
    first = start.agg(F.first("next_id")).scalar() if isinstance(start, DataFrame) else F.lit(start)
    new_id = (first + F.col("_off") + within).cast("bigint")
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn("new_id", new_id)
            .withColumn("reference", reference_code(prefix, F.col("new_id") + 1))
            .drop("_pid", "_pos", "_off"))


def _positioned(df: DataFrame, order: Sequence[str], num_partitions: int | None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, stored with their
    partition ``_pid`` and increasing position ``_pos``."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return store(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), "positions")


def next_ids(df: DataFrame, floor: int = 1, col: str = "id") -> DataFrame:
    """Next id = max(floor, max(id) + 1)."""
    return df.agg(F.greatest(F.lit(floor).cast("bigint"),
                             F.coalesce(F.max(col).cast("bigint") + 1, F.lit(floor).cast("bigint"))).alias("next_id"))


def load_users_merge(base: DataFrame, saved: DataFrame, order: str = "pos", present: str | None = None) -> DataFrame:
    """Overlay saved users onto base users by lower(email). Saved records
    of one e-mail apply in ``order``, field by field; saved users without a
    match are appended. ``present`` names an array column with the fields a
    saved record carries: others are absent and keep what was there (a
    carried null overwrites). Without it every record carries all columns."""
    fields = [c for c in saved.columns if c not in (order, present)]

    def last(c: str) -> Column:
        at = F.col(order) if present is None else F.when(F.array_contains(present, c), F.col(order))
        return F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_s_{c}")

    merged = saved.withColumn("_k", F.lower("email")).groupBy("_k").agg(*[last(c) for c in fields])
    joined = base.withColumn("_k", F.lower("email")).join(merged, "_k", "full_outer")
    cols = list(dict.fromkeys(base.columns + fields))

    def pick(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        value = F.col(f"_s_{c}.v")
        return F.when(F.col(f"_s_{c}").isNotNull(), value).otherwise(F.col(c)) if c in base.columns else value

    return joined.select(*[pick(c).alias(c) for c in cols])


def load_permissions_merge(base: DataFrame, saved: DataFrame, order: str = "pos") -> DataFrame:
    """Insert-if-absent on (user_id, module): base rows win, then the
    first saved row per pair."""
    first = (saved.groupBy("user_id", "module")
             .agg(F.min_by(F.struct(*[c for c in saved.columns if c not in ("user_id", "module", order)]),
                           order).alias("_s"))
             .select("user_id", "module", "_s.*"))
    add = first.join(base.select("user_id", "module"), ["user_id", "module"], "left_anti")
    return base.unionByName(add, allowMissingColumns=True)


def feed_audit_rows(feed: DataFrame, key: str, module: str, record_type: str, label_col: str,
                    updated_text: str) -> DataFrame:
    """E10 for a create / update / delete feed: one audit row per applied
    change, as the reference writes them:

    create -> 'Created', field '', old '', new = the record's label;
    update -> 'Updated', field 'details', old '', new = ``updated_text``;
    delete -> 'Deleted', field '', old = the label the record had, new ''.

    Updates and deletes of a record that does not exist are not applied and
    not audited (see feed_rejects). One ordered scan per key for 'exists'
    and 'current label' (hot keys are split); null values become ''.
    """
    op = F.col("op")
    write = op.isin("create", "update")
    rows = feed.select(key, "seq", "op", F.col(label_col).alias("_label"))
    rows = prefix_scans(rows, [key], ["seq"],
                        [(F.when(op.isin("create", "delete"), op), "last", "_prev_life"),
                         (F.when(write, F.struct(F.col("_label").alias("v"))), "last", "_prev_label")],
                        inclusive=False)
    applied = rows.filter((op == "create") | F.coalesce(F.col("_prev_life") == "create", F.lit(False)))
    action = F.when(op == "create", "Created").when(op == "update", "Updated").otherwise("Deleted")
    return applied.select(
        "seq", F.lit(module).alias("module"), F.lit(record_type).alias("record_type"),
        F.col(key).cast("string").alias("record_id"), action.alias("action"),
        F.when(op == "update", "details").otherwise("").alias("field_changed"),
        null_to_empty(F.when(op == "delete", F.col("_prev_label.v"))).alias("old_value"),
        null_to_empty(F.when(op == "create", F.col("_label"))
                      .when(op == "update", F.lit(updated_text))).alias("new_value"))


def patch_rejects(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """E7a/E7b rejects: patches for a key that is not in ``base`` (the
    reference answers 404 and changes nothing). One anti join."""
    return (patches.join(base.select(key), key, "left_anti")
            .select(key, "seq", F.lit("not found").alias("error")))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_number",
                  num_partitions: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number() over (partition by keys order by order), where no task
    has to hold a hot key.

    Rows are counted by hash groups of the keys. Groups of at most ``hot_rows``
    rows take the plain window, one exchange; the others are numbered by their
    written positions (``_number_pieces``). Ties in ``order`` go by a hash of
    the row, and equal rows get distinct numbers, as with row_number.
    """
    keys, order = list(keys), list(order)
    small, hot = split_hot(df, keys, df, hot_rows)
    parts = []
    if small is not None:
        parts.append(number_small(small, keys, order, out))
    if hot is not None:
        parts.append(_number_pieces(hot, keys, order, out, num_partitions))
    return reduce(DataFrame.unionByName, parts)


def number_small(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_number",
                 num_partitions: int | None = None) -> DataFrame:
    """``number_within`` for keys that are known to be small: the plain window.
    Rows are dealt by key first (into ``num_partitions``, if given), so that the
    hash that settles ties is taken after the exchange and not moved."""
    w = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*df.columns))
    dealt = df.repartition(num_partitions, *keys) if num_partitions else df.repartition(*keys)
    return dealt.withColumn(out, F.row_number().over(w).cast("bigint"))


def _number_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, num_partitions: int | None) -> DataFrame:
    """Range-partition on (keys, order), sort inside partitions and write the
    rows with their position, which then stays if an executor is lost. A hot key
    then spans several partitions. Per (partition, key), take the first
    position and the count: one row per piece of a key. Add prefix offsets
    over the pieces of each key, which are at most one per partition. The
    number is offset + position - first + 1."""
    cols = [*keys, *order]
    tagged = _positioned(df, cols, num_partitions)
    pieces = tagged.groupBy("_pid", *keys).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("_pid").alias("_p_pid"), *[F.col(k).alias(f"_p_{k}") for k in keys],
                           "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    cond = [tagged["_pid"] == pieces["_p_pid"]] + [tagged[k].eqNullSafe(pieces[f"_p_{k}"]) for k in keys]
    return (tagged.join(pieces, cond)
            .withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_first", "_off", "_p_pid", *[f"_p_{k}" for k in keys]))
