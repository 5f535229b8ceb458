"""Integrity rules as a data-quality job (H1-H7, H9; H8 lives in ledger).

Every check returns rows (rule, table_name, key, detail), all strings, so
``violations`` is a plain union of checks. Each check is one scan with a
filter, or one aggregate / anti join; no check collects anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _out(df: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     key.alias("key"), detail.cast("string").alias("detail"))


def check_unique(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """H1: key values that occur more than once."""
    g = df.groupBy(*key).count().filter(F.col("count") > 1)
    return _out(g, "unique", table, _key(key), F.concat(F.lit("count="), F.col("count").cast("string")))


def check_foreign_key(child: DataFrame, table: str, cols: Sequence[str], parent: DataFrame,
                      parent_cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """H2: child rows whose non-null reference has no parent row."""
    p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(parent_cols, cols)])
    c = child.filter(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cols]))
    miss = c.join(p, list(cols), "left_anti")
    return _out(miss, "foreign_key", table, _key(key),
                F.concat(F.lit(",".join(cols) + "="), _key(cols)))


def check_domain(df: DataFrame, table: str, col: str, values: Sequence[str],
                 key: Sequence[str]) -> DataFrame:
    """H3: values outside the allowed list (null passes, as CHECK does)."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return _out(bad, "domain", table, _key(key), F.concat(F.lit(col + "="), F.col(col).cast("string")))


def check_not_null(df: DataFrame, table: str, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """H4: one row per (row, column) that is null."""
    parts = [_out(df.filter(F.col(c).isNull()), "not_null", table, _key(key), F.lit(c)) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def check_length(df: DataFrame, table: str, col: str, max_len: int, key: Sequence[str]) -> DataFrame:
    """H5: text longer than max_len characters."""
    bad = df.filter(F.char_length(col) > max_len)
    return _out(bad, "length", table, _key(key),
                F.concat(F.lit(col + " length="), F.char_length(col).cast("string")))


def check_precision(df: DataFrame, table: str, col: str, precision: int, scale: int,
                    key: Sequence[str]) -> DataFrame:
    """H6: values that do not fit decimal(precision, scale) without loss:
    out of range, or more fractional digits than the scale."""
    t = f"decimal({precision},{scale})"
    v = F.col(col)
    fitted = v.try_cast(t)
    bad = df.filter(v.isNotNull() & (fitted.isNull() | (fitted.cast("double") != v.cast("double"))))
    return _out(bad, "precision", table, _key(key), F.concat(F.lit(f"{col} not {t}: "), v.cast("string")))


def check_required(df: DataFrame, table: str, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """H9: required text that is null or blank."""
    parts = [_out(df.filter(F.col(c).isNull() | (F.trim(F.col(c)) == "")), "required", table, _key(key), F.lit(c))
             for c in cols]
    return reduce(DataFrame.unionByName, parts)


def cascade_delete(children: DataFrame, parents_left: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """H7: children that survive a delete of parents (semi join with the
    remaining parents): ON DELETE CASCADE as a filter."""
    return children.join(parents_left.select(F.col(pk).alias(fk)), fk, "left_semi")


def orphans(children: DataFrame, parents_left: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """H7, reference behaviour: children whose parent was deleted stay; this
    reports them (anti join)."""
    return children.join(parents_left.select(F.col(pk).alias(fk)), fk, "left_anti")


def violations(checks: Sequence[DataFrame]) -> DataFrame:
    """All rule violations in one frame."""
    return reduce(DataFrame.unionByName, checks)


def check_rows(df: DataFrame, table: str, rules: Sequence[tuple[str, Column, Column]], key: Sequence[str]) -> DataFrame:
    """Rules that a row breaks by itself, (rule, condition, detail) each, in
    one scan: one row per (row, broken rule)."""
    broken = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in rules])
    out = df.select(_key(key).alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("b"))
    return out.select("b.rule", F.lit(table).alias("table_name"), "key", "b.detail")


def check_keys(tables: dict[str, DataFrame], keysets: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """H1 for many unique keys (table, columns): each table is read once for
    all its keys, and one aggregate counts the keys of all tables."""
    frames = []
    for t in dict.fromkeys(t for t, _ in keysets):
        each = F.array(*[F.struct(F.lit(i).alias("i"), _key(ks).alias("key")) for i, (of, ks) in enumerate(keysets) if of == t])
        frames.append(tables[t].select(F.lit(t).alias("table_name"), F.inline(each)))
    counts = reduce(DataFrame.unionByName, frames).groupBy("key", "i", "table_name").agg(F.count("*").alias("n")).filter("n > 1")  # see check_references
    return counts.select(F.lit("unique").alias("rule"), "table_name", "key", F.concat(F.lit("count="), F.col("n").cast("string")).alias("detail"))


def check_references(tables: dict[str, DataFrame], keys: Sequence[tuple[str, str, str]]) -> DataFrame:
    """H2 for all foreign keys (child, column, parent): each child is read once
    for all its columns, and all references meet all parents in one join. Ids
    compare as text; null references break nothing."""
    from stockflow.operators.deletes import TO, references
    found = reduce(DataFrame.unionByName, [tables[p].select(F.lit(p).alias("to_table"), F.col("id").cast("string").alias("to_key"))
                                           for p in dict.fromkeys(k[2] for k in keys)])
    # The key before the table: a sort tells rows apart by the start of its first column.
    lost = references(tables, keys).join(found, TO[::-1], "left_anti")
    column = F.substring_index("fk", ".", -1)
    return lost.select(F.lit("foreign_key").alias("rule"), "table_name", F.coalesce("key", F.lit("NULL")).alias("key"),
                       F.concat(column, F.lit("="), F.col("to_key")).alias("detail"))


def skipped_rules(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(rule, table, column) of the schema rules that ``entity_violations``
    cannot apply, because the table or the column is not in ``tables``."""
    from stockflow import schemas as R
    rules = [("unique", t, c) for t, sets in R.UNIQUE.items() for ks in sets for c in ks]
    rules += [("foreign_key", t, c) for t, c, _ in R.FOREIGN_KEYS] + [("foreign_key", p, "id") for _, _, p in R.FOREIGN_KEYS]
    rules += [("domain", t, c) for t, c, _ in R.DOMAINS] + [("not_null", t, c) for t, cs in R.NOT_NULL.items() for c in cs]
    rules += [("length", t, c) for t, c, _ in R.LENGTH] + [("required", t, c) for t, cs in R.REQUIRED for c in cs]
    return sorted({r for r in rules if r[1] not in tables or r[2] not in tables[r[1]].columns})


def entity_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All schema rules (stockflow.schemas) over the entity tables given;
    rules whose tables or columns are missing are skipped (``skipped_rules``
    names them)."""
    from stockflow import schemas as R
    has = lambda t, *cols: t in tables and set(cols) <= set(tables[t].columns)
    unique = [(t, ks) for t, keysets in R.UNIQUE.items() for ks in keysets if has(t, *ks)]
    checks = [check_keys(tables, unique)] if unique else []
    keys = [k for k in R.FOREIGN_KEYS if has(k[0], k[1], "id") and has(k[2], "id")]
    if keys:
        checks.append(check_references(tables, keys))
    rules: dict[str, list[tuple[str, Column, Column]]] = {}
    add = lambda t, col, *rule: rules.setdefault(t, []).append(rule) if has(t, col) else None
    for t, col, values in R.DOMAINS:
        c = F.col(col)
        add(t, col, "domain", c.isNotNull() & ~c.isin(*values), F.concat(F.lit(col + "="), c.cast("string")))
    for t, cols in R.NOT_NULL.items():
        for col in cols:
            add(t, col, "not_null", F.col(col).isNull(), F.lit(col))
    for t, col, n in R.LENGTH:
        add(t, col, "length", F.char_length(col) > n, F.concat(F.lit(col + " length="), F.char_length(col).cast("string")))
    for t, cols in R.REQUIRED:
        for col in cols:
            add(t, col, "required", F.col(col).isNull() | (F.trim(F.col(col)) == ""), F.lit(col))
    for t, of in rules.items():
        key = ["id"] if has(t, "id") else [c for c in R.UNIQUE[t][0] if has(t, c)] or tables[t].columns[:1]
        checks.append(check_rows(tables[t], t, of, key))
    return violations(checks)


def cascade_delete_all(tables: dict[str, DataFrame], left: dict[str, DataFrame]) -> DataFrame:
    """H7 over every row of schemas.CASCADE: (table_name, key) of the children
    that survive when of each parent table only the rows in ``left`` remain."""
    from stockflow import schemas as R
    return violations([cascade_delete(tables[t], left[parent], col).select(F.lit(t).alias("table_name"), _key(["id"]).alias("key"))
                       for t, col, parent in R.CASCADE if t in tables and parent in left])
