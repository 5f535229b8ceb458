"""Ordered prefix aggregates per key that stay parallel under hot keys.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of one key
into one task; if one key holds a third of the rows, that task holds a third
of the data. Here rows are range-partitioned on (key, order, hash of the
row), so pieces are bounded by volume: a key takes as many pieces as its
rows need, whatever its order values look like (ties and outliers included).

1. aggregate per (piece, key): at most one row per key and partition;
2. exclusive prefix of those rows per key;
3. window inside (piece, key), combined with the piece's offset.

The answer equals the plain window for sum, max, min and last-value, since
all are associative. Steps 1 and 3 must see the same pieces. Over a plain scan
they read one exchange, which Spark reuses since both need all columns; nothing
runs when the plan is built, and should the pieces ever differ, the query fails
loudly. Over joins and other scans, whose plans Spark may change while it runs,
``settle`` writes the pieces once and both read them.

Most keys are small, and pieces cost them an exchange, a table and two joins.
``settle`` therefore counts the rows by hash groups of the keys first. Groups
of few rows hold no hot key: their rows take the plain window, one exchange.
Rows of the others take the pieces. The counts decide how a row is scanned,
never its result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stockflow.stored import store

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}

GROUPS = 8192          # hash groups of keys that are counted
HOT_ROWS = 1_000_000   # rows of a group from which it may hold a hot key


def _group(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")


def hot_groups(sizes: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hash groups of ``keys`` with more than ``hot_rows`` rows in ``sizes``
    (and four times the average, so that not all are, however many rows there
    are). At most one row per group comes to the driver."""
    counts = {r["g"]: r["n"] for r in sizes.groupBy(_group(keys).alias("g")).agg(F.count("*").alias("n")).collect()}
    least = max(hot_rows, 4 * sum(counts.values()) // GROUPS)
    return sorted(g for g, n in counts.items() if n > least)


def split_hot(df: DataFrame, keys: Sequence[str], sizes: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose keys are all small, rows that may belong to a hot key);
    None for a part that has no rows. All rows of a key are in one part."""
    if not keys:
        return None, df
    groups = hot_groups(sizes, keys, hot_rows)
    if not groups:
        return df, None
    hot = _group(keys).isin(groups)
    return df.filter(~hot), df.filter(hot)


def _combine(op: str, offset: Column, inner: Column) -> Column:
    if op == "sum":
        return (F.when(offset.isNull(), inner).when(inner.isNull(), offset)
                 .otherwise(offset + inner))
    if op == "max":
        return F.greatest(offset, inner)
    if op == "min":
        return F.least(offset, inner)
    if op == "last":
        return F.coalesce(inner, offset)
    raise ValueError(op)


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str,
                op: str, out: str, inclusive: bool = True, num_partitions: int | None = None,
                carry: DataFrame | None = None, settle: bool = False, sizes: DataFrame | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add column ``out`` = op over rows of the same key up to this row.

    ``inclusive=False`` excludes the row itself (a 'before' value). ``last``
    returns the last non-null value in order. Nulls are skipped by every op;
    no rows -> null. Rows that tie in ``order`` are taken in the order of a
    hash of all their columns.
    """
    return prefix_scans(df, keys, order, [(value, op, out)], inclusive, num_partitions, carry, settle, sizes, hot_rows)


def prefix_scans(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 specs: Sequence[tuple[Column | str, str, str]], inclusive: bool = True,
                 num_partitions: int | None = None, carry: DataFrame | None = None, settle: bool = False,
                 sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Several prefix values over the same key and order in one pass:
    ``specs`` = [(value, op, out), ...]. However many values are scanned,
    there is one exchange and one window (for hot keys one range exchange, one
    aggregate, one offset join and one window). ``num_partitions``: pieces
    overall (default: the session's shuffle partitions, which
    ``session.tune_for_input`` sizes from the data).
    ``carry``: a state that the scan starts from (see ``scan_carry``), at most
    one row per key. It meets the pieces, never the rows, or leads the small
    keys' windows as a row.
    ``settle``: split hot from small keys and write the hot ones' pieces before
    they are read (see above). The rows are written and counted, or, where
    ``sizes`` has about as many rows per key, that frame is counted instead."""
    keys, order = list(keys), list(order)
    vals = [(F.col(v) if isinstance(v, str) else v, op, out) for v, op, out in specs]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not settle:
        return _pieces(df, keys, order, vals, inclusive, n, carry, False)
    if sizes is None and keys:
        df = sizes = store(df, "rows")
    small, hot = split_hot(df, keys, sizes, hot_rows)
    parts = [_windowed(small, keys, order, vals, inclusive, carry)] if small is not None else []
    if hot is not None:
        parts.append(_pieces(hot, keys, order, vals, inclusive, n, carry, True))
    return reduce(DataFrame.unionByName, parts)


def _windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], vals: Sequence[tuple[Column, str, str]], inclusive: bool,
              carry: DataFrame | None) -> DataFrame:
    """The plain window, for keys that one task can hold."""
    rows = df.withColumn("_tie", F.xxhash64(*df.columns))
    if carry is not None:
        ins = [f"_in{i}" for i in range(len(vals))]
        rows = rows.withColumns({v: val for v, (val, _, _) in zip(ins, vals)} | {"_lead": F.lit(1)})
        known = {k: F.col(k) for k in keys} | {v: F.col(out) for v, (_, _, out) in zip(ins, vals)} | {"_lead": F.lit(0)}
        rows = rows.unionByName(carry.select(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
        vals = [(F.col(v), op, out) for v, (_, op, out) in zip(ins, vals)]
        order = ["_lead", *order]
    w = Window.partitionBy(*keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    done = rows.withColumns({out: _over(val, op, w) for val, op, out in vals})
    if carry is not None:
        leads = F.sum(1 - F.col("_lead")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        done = done.withColumn("_leads", leads).filter(F.when(F.col("_leads") <= 1, F.col("_lead") == 1).otherwise(
            F.raise_error(F.lit("the state of a scan has several rows of one key")).cast("boolean"))).drop("_lead", "_leads", *ins)
    return done.drop("_tie")


def _over(val: Column, op: str, w: WindowSpec) -> Column:
    return F.last(val, ignorenulls=True).over(w) if op == "last" else _AGG[op](val).over(w)


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], vals: Sequence[tuple[Column, str, str]], inclusive: bool,
            n: int, carry: DataFrame | None, settle: bool) -> DataFrame:
    """The scan in pieces of keys."""
    row = F.xxhash64(*df.columns)
    ranged = (df.repartitionByRange(n, *keys, *order, row)
              .withColumns({"_piece": F.spark_partition_id(), "_tie": row}))
    if settle:
        ranged = store(ranged, "pieces")
    frame_end = Window.currentRow if inclusive else -1

    # 1. one row per key and piece (max of _tie: this side, too, needs every column)
    aggs = [F.count("*").alias("_rows"), F.max("_tie").alias("_max_tie")]
    for i, (val, op, _) in enumerate(vals):
        if op == "last":
            aggs.append(F.max_by(val, F.when(val.isNotNull(), F.struct(*order, "_tie"))).alias(f"_agg{i}"))
        else:
            aggs.append(_AGG[op](val).alias(f"_agg{i}"))
    pieces = ranged.groupBy(*keys, "_piece").agg(*aggs)

    # 2. what comes before each piece of a key
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    priors = [(F.last(f"_agg{i}", ignorenulls=True) if op == "last" else _AGG[op](f"_agg{i}")).over(before).alias(f"_off{i}")
              for i, (_, op, _) in enumerate(vals)]
    # Null-safe keys, so null keys keep their offsets as in the plain window
    # (Spark plans <=> as an equi-join, so this stays a hash / sort-merge join).
    offsets = pieces.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_piece").alias("_o_piece"),
                            "_rows", "_max_tie", *priors)
    if carry is not None:
        start = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(out).alias(f"_carry{i}") for i, (_, _, out) in enumerate(vals)])
        offsets = (offsets.join(start, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_c_{k}")) for k in keys], "left")
                   .withColumns({f"_off{i}": _combine(op, F.col(f"_carry{i}"), F.col(f"_off{i}")) for i, (_, op, _) in enumerate(vals)})
                   .drop(*[f"_c_{k}" for k in keys], *[f"_carry{i}" for i in range(len(vals))]))
    cond = [ranged[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys] + [ranged["_piece"].eqNullSafe(offsets["_o_piece"])]
    joined = ranged.join(offsets, on=cond, how="left").drop(*[f"_o_{k}" for k in keys], "_o_piece")

    # 3. the window inside a piece
    inside = Window.partitionBy(*keys, "_piece")
    w = inside.orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, frame_end)

    same = F.count("*").over(inside).eqNullSafe(F.col("_rows")) & F.max("_tie").over(inside).eqNullSafe(F.col("_max_tie"))
    scanned = joined.withColumns({"_same": same} | {out: _combine(op, F.col(f"_off{i}"), _over(val, op, w))
                                                    for i, (val, op, out) in enumerate(vals)})
    checked = scanned.filter(F.when(F.col("_same"), F.lit(True)).otherwise(
        F.raise_error(F.lit("prefix scan saw two different partitionings")).cast("boolean")))
    return checked.drop("_piece", "_tie", "_rows", "_max_tie", "_same", *[f"_off{i}" for i in range(len(vals))])


def scan_carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[tuple[Column | str, str, str]],
               carry: DataFrame | None = None, through: str = "through") -> DataFrame:
    """The state after ``df``, from which a later batch resumes: per key the
    value of every spec over all rows so far, and ``through``, the last order
    values. ``carry`` is the state before. One aggregate of the new rows, then
    one row per key meets one row per key."""
    keys, order = list(keys), list(order)
    vals = [(F.col(v) if isinstance(v, str) else v, op, out) for v, op, out in specs]
    at = F.struct(*order)
    tie = F.xxhash64(*df.columns)
    aggs = [(F.max_by(val, F.when(val.isNotNull(), F.struct(at, tie))) if op == "last" else _AGG[op](val)).alias(out) for val, op, out in vals]
    new = df.groupBy(*keys).agg(*aggs, F.max(at).alias(through))
    if carry is None:
        return new
    old = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(out).alias(f"_c_{out}") for _, _, out in vals], F.col(through).alias("_c_through"))
    met = new.withColumn("_new", F.lit(True)).join(old, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys], "full_outer")
    return met.select(*[F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_c_{k}")).alias(k) for k in keys],
                      *[_combine(op, F.col(f"_c_{out}"), F.col(out)).alias(out) for _, op, out in vals],
                      F.greatest(F.col(through), F.col("_c_through")).alias(through))


def split_late(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: DataFrame, through: str = "through") -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows after the state's last order values of their key,
    and rows at or before them, which belonged into an earlier batch. Keys
    without a state, or with one that has seen no row, are on time."""
    keys = list(keys)
    seen = carry.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(through).alias("_c_through"))
    met = df.join(seen, [df[k].eqNullSafe(seen[f"_c_{k}"]) for k in keys], "left")
    late = F.coalesce(F.struct(*[df[c] for c in order]) <= F.col("_c_through"), F.lit(False))
    return met.filter(~late).select(*[df[c] for c in df.columns]), met.filter(late).select(*[df[c] for c in df.columns])
