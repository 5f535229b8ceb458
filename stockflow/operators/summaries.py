"""Order and BoM summaries.

``flat=True`` (the default) gives one row per (header, child) with the
header's columns repeated and headers without children kept once with null
child columns: the scalable form, since no group is gathered into one row.
``flat=False`` gives the nested document form of the reference's views:
``array<struct>`` children (empty array when none), each child table
aggregated separately so two children never multiply (no components x
operations fan-out). A document holds at most ``CHUNK`` children of a kind;
a header with more has several documents, numbered by ``chunk_no`` in the
order of the children, which together hold every child.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import availability
from stockflow.operators.bom import with_finished_product
from stockflow.operators.lines import line_total
from stockflow.operators.scan import prefix_scan


# Children of a kind that one nested document holds.
CHUNK = 10_000


def _chunks(df: DataFrame, key: str, fields: Sequence[Column | str], out: str, present: str | None,
            distinct: bool, size: int, every: bool = True) -> DataFrame:
    """(key, chunk_no, out): the children of each key in order, cut into arrays
    of at most ``size``. Children are numbered by a scan that splits large keys,
    so that no task holds all children of one. With ``every``, every key of
    ``df`` has a chunk 0; without, only keys with a child have chunks."""
    child = F.struct(*[F.col(f) if isinstance(f, str) else f for f in fields])
    rows = (df.filter(F.col(present).isNotNull()) if present else df).select(key, child.alias("_child"))
    if distinct:
        rows = rows.distinct()
    numbered = prefix_scan(rows, [key], ["_child"], F.lit(1), "sum", "_no", settle=True)
    arrays = (numbered.groupBy(key, F.floor((F.col("_no") - 1) / size).cast("long").alias("chunk_no"))
              .agg(F.sort_array(F.collect_list("_child")).alias(out)))
    if not every:
        return arrays
    empty = F.array().cast(arrays.schema[out].dataType)
    some = arrays.withColumnRenamed(key, "_k")
    return (df.select(key).distinct().join(some, F.col(key).eqNullSafe(F.col("_k")), "left")
            .select(key, F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), F.coalesce(out, empty).alias(out)))


def collect_present(df: DataFrame, key: str, fields: Sequence[Column | str], out: str,
                    present: str = "id", size: int = CHUNK) -> DataFrame:
    """D12 (+ D11): per key, sorted arrays of the child structs whose
    ``present`` column is not null (key, chunk_no, out); an empty array when
    there are none."""
    return _chunks(df, key, fields, out, present, False, size)


def collect_distinct(df: DataFrame, key: str, fields: Sequence[Column | str], out: str,
                     size: int = CHUNK) -> DataFrame:
    """Per key, sorted arrays of the distinct child structs (the
    reference's json_agg(distinct ...)): key, chunk_no, out."""
    return _chunks(df, key, fields, out, None, True, size)


def attach_children(headers: DataFrame, key: str, children: DataFrame, child_key: str,
                    out: str, fields: Sequence[str], flat: bool, size: int = CHUNK) -> DataFrame:
    """C11: left join headers onto their children (flat) or onto the child
    arrays (nested; headers without children get []). Headers that already
    have a ``chunk_no`` share it: chunk k of one kind stands with chunk k of
    the other, so two kinds never multiply."""
    if flat:
        c = children.select(F.col(child_key).alias(key), *fields)
        return headers.join(c, key, "left")
    # Headers without a chunk get an empty one below, so children are read once.
    arr = _chunks(children.withColumnRenamed(child_key, key), key, fields, out, fields[0], False, size, every=False)
    kind = arr.schema[out].dataType
    if "chunk_no" not in headers.columns:
        joined = headers.join(arr, key, "left").withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0).cast("long")))
        return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(kind)))
    # Chunks beyond those of the first kind: the header again, its own arrays empty.
    arrays = [f.name for f in headers.schema if f.dataType.typeName() == "array"]
    first = headers.filter("chunk_no = 0")
    more = arr.join(headers.select(key, "chunk_no"), [key, "chunk_no"], "left_anti").select(key, F.col("chunk_no").alias("_more"))
    extra = first.join(more, key).withColumn("chunk_no", F.col("_more")).drop("_more")
    extra = extra.withColumns({a: F.array().cast(headers.schema[a].dataType) for a in arrays})
    joined = headers.unionByName(extra.select(*headers.columns)).join(arr, [key, "chunk_no"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(kind)))


def with_owner_name(df: DataFrame, users: DataFrame, col: str, name: str) -> DataFrame:
    """Owner name by a left join. No broadcast hint: AQE turns the join
    into a broadcast from the measured size of the users side, and keeps a
    shuffle join when that side is large."""
    u = users.select(F.col("id").alias(col), F.col("name").alias(name))
    return df.join(u, col, "left")


def _product_rows(products: DataFrame, position: DataFrame) -> DataFrame:
    """One row per product: its columns and its stock position. Products known
    on one side only keep nulls for the other."""
    pos = position.select("product_id", "on_hand_qty", "reserved_qty")
    return products.drop("on_hand_qty", "reserved_qty").join(pos, "product_id", "full_outer")


def _line_rows(lines: DataFrame, products: DataFrame, position: DataFrame | None,
               price_col: str, with_availability: bool) -> DataFrame:
    """Lines (or headers already joined to their lines) with what their product
    gives them."""
    # The line's own price wins (the views read the stored line price); lines
    # without one take the product's current price, as at line creation.
    p = products.select("product_id", "product_name", *([] if "unit_price" in lines.columns else [F.col(price_col).alias("unit_price")]))
    if not (with_availability and position is not None):
        out = lines.join(p, "product_id", "left")
    else:  # names, prices and stock as one row per product, joined once
        about = _product_rows(p, position)
        out = (lines.join(about, "product_id", "left")
               .withColumn("availability", availability("ordered_qty", "on_hand_qty", "reserved_qty", "sales")))
    return out.withColumn("total", line_total("unit_price", "ordered_qty", "done_qty", "view"))


def sales_order_summary(orders: DataFrame, lines: DataFrame, products: DataFrame,
                        users: DataFrame, position: DataFrame, flat: bool = True, keyed: bool = False) -> DataFrame:
    """Order + sales person name + lines (product name, availability,
    ordered, delivered, unit price, total by the view rule).

    The flat form joins orders to lines before anything else: a line is moved by
    its order once, and what its product gives it is not moved back.
    ``keyed``: orders and lines are stored by order (sources.keyed), so that this
    join needs no exchange."""
    if flat:
        own = [c for c in lines.columns if c in ("line_seq", "product_id", "ordered_qty", "done_qty", "unit_price")]
        both = orders.join(lines.select(F.col("order_id").alias("id"), *own, F.lit(True).alias("_there")), "id", "left")
        rows = with_owner_name(_line_rows(both, products, position, "sales_price", True), users, "sales_person_id", "sales_person_name")
        first = [] if keyed else ["id", "sales_person_id"]
        return rows.select(*first, *[c for c in orders.columns if c not in first], "sales_person_name", "line_seq", "product_id", "product_name",
                           F.when(F.col("_there"), F.col("availability")).alias("availability"), "ordered_qty",
                           F.col("done_qty").alias("delivered_qty"), "unit_price", "total")
    hdr = with_owner_name(orders, users, "sales_person_id", "sales_person_name")
    rows = _line_rows(lines, products, position, "sales_price", True)
    fields = ["line_seq", "product_id", "product_name", "availability", "ordered_qty",
              F.col("done_qty").alias("delivered_qty"), "unit_price", "total"]
    rows = rows.select("order_id", *fields)
    names = [f if isinstance(f, str) else "delivered_qty" for f in fields]
    return attach_children(hdr, "id", rows, "order_id", "lines", names, flat)


def purchase_order_summary(orders: DataFrame, lines: DataFrame, products: DataFrame,
                           users: DataFrame, flat: bool = True) -> DataFrame:
    """Order + responsible person + lines with total by the view rule."""
    hdr = with_owner_name(orders, users, "responsible_person_id", "responsible_person_name")
    rows = _line_rows(lines, products, None, "cost_price", False).select(
        "order_id", "line_seq", "product_id", "product_name", "ordered_qty",
        F.col("done_qty").alias("received_qty"), "unit_price", "total")
    names = ["line_seq", "product_id", "product_name", "ordered_qty", "received_qty",
             "unit_price", "total"]
    return attach_children(hdr, "id", rows, "order_id", "lines", names, flat)


def manufacturing_order_summary(mos: DataFrame, components: DataFrame, work_orders: DataFrame,
                                products: DataFrame, users: DataFrame, position: DataFrame,
                                flat: bool = True) -> tuple[DataFrame, DataFrame] | DataFrame:
    """MO + finished product (inner join) + assignee + components (with
    availability 'Available' / 'Not Available') and work orders.

    flat=True returns (component rows, work order rows), each with the MO
    header; nested returns one row with both arrays.
    """
    hdr = with_owner_name(with_finished_product(mos, products), users, "assignee_id", "assignee_name")
    about = _product_rows(products.select("product_id", "product_name"), position)
    comp = (components.join(about, "product_id", "left")
            .withColumn("availability", availability("to_consume_qty", "on_hand_qty", "reserved_qty", "mo")))
    cf = ["product_id", "product_name", "availability", "to_consume_qty", "consumed_qty"]
    wf = ["operation_name", "work_center", "expected_duration", "real_duration", "status"]
    wo = work_orders.withColumnRenamed("status", "wo_status")
    wf_cols = [c if c != "status" else "wo_status" for c in wf]
    if flat:
        return (attach_children(hdr, "id", comp, "mo_id", "components", cf, True),
                attach_children(hdr, "id", wo, "mo_id", "operations", wf_cols, True))
    out = attach_children(hdr, "id", comp, "mo_id", "components", cf, False)
    return attach_children(out, "id", wo, "mo_id", "operations", wf_cols, False)


def bom_summary(boms: DataFrame, components: DataFrame, operations: DataFrame,
                products: DataFrame, flat: bool = True) -> tuple[DataFrame, DataFrame] | DataFrame:
    """BoM + finished product name (inner) + components (with names) and
    operations."""
    hdr = with_finished_product(boms, products)
    names = products.select(F.col("product_id").alias("component_product_id"),
                            F.col("product_name").alias("component_name"))
    comp = components.join(names, "component_product_id", "left")
    cf = ["component_product_id", "component_name", "to_consume_qty"]
    of = ["operation_name", "work_center", "expected_duration"]
    if flat:
        return (attach_children(hdr, "id", comp, "bom_id", "components", cf, True),
                attach_children(hdr, "id", operations, "bom_id", "operations", of, True))
    out = attach_children(hdr, "id", comp, "bom_id", "components", cf, False)
    return attach_children(out, "id", operations, "bom_id", "operations", of, False)
