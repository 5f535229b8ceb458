"""Order lines: validation, lookup, enrichment and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import availability, exact_sum, or_default
from stockflow.types import MONEY_SUM, QTY


def valid_lines(lines: DataFrame) -> DataFrame:
    """Drop lines with an empty or 0 product; ordered 0/null -> 1;
    done null -> 0."""
    return (lines.filter(F.coalesce(F.col("product_id") != 0, F.lit(False)))
            .withColumn("ordered_qty", or_default("ordered_qty", F.lit(1).cast(QTY)).cast(QTY))
            .withColumn("done_qty", F.coalesce("done_qty", F.lit(0)).cast(QTY)))


def lookup(rows: DataFrame, ref: DataFrame, row_key: str, ref_key: str,
           label: str) -> tuple[DataFrame, DataFrame]:
    """By-id fetch. Returns (found, missing); a key that is not a number
    or has no match goes to ``missing`` with an error text, as a 404 would."""
    k = F.col(row_key).cast("string").try_cast("bigint")
    keyed = rows.withColumn("_k", k)
    r = ref.select(F.col(ref_key).cast("bigint").alias("_k"))  # semi and anti joins need no distinct
    found = keyed.join(r, "_k", "left_semi").drop("_k")
    missing = (keyed.join(r, "_k", "left_anti").drop("_k")
               .withColumn("error", F.lit(f"{label} not found")))
    return found, missing


def enrich_lines(lines: DataFrame, products: DataFrame, kind: str,
                 position: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A line takes product name, unit and the product's price (sales
    price for sales lines, cost price for purchase lines; a price sent with
    the line is ignored), the booked total price x ordered, and availability
    as free >= ordered. Lines whose product is missing are returned as
    rejects."""
    price_col = "sales_price" if kind == "sales" else "cost_price"
    prod = products.select("product_id", "product_name",
                           F.coalesce(*([F.col("unit")] if "unit" in products.columns else []),
                                      F.lit("Units")).alias("unit"),
                           F.col(price_col).alias("unit_price"))
    # One left join on the product, split on whether it was found.
    known = prod.withColumnRenamed("product_id", "_k").withColumn("_found", F.lit(True))
    bare = lines.drop(*[c for c in ("product_name", "unit", "unit_price") if c in lines.columns])
    joined = bare.withColumn("_k", F.col("product_id").cast("string").try_cast("bigint")).join(known, "_k", "left").drop("_k")
    rejects = (joined.filter(F.col("_found").isNull()).select(*[c for c in bare.columns])
               .withColumn("error", F.lit("Product not found")))
    out = joined.filter(F.col("_found")).drop("_found")
    out = out.withColumn("total", (F.col("unit_price") * F.col("ordered_qty")).cast(MONEY_SUM))
    if position is not None:
        pos = position.select("product_id", "on_hand_qty", "reserved_qty")
        out = (out.join(pos, "product_id", "left")
               .withColumn("availability", availability("ordered_qty", "on_hand_qty", "reserved_qty",
                                                         "snapshot"))
               .drop("on_hand_qty", "reserved_qty"))
    return out, rejects


def line_total(price: str, ordered: str, done: str, rule: str = "view"):
    """D19 per line. 'booked': price x ordered. 'view': done qty if > 0,
    else ordered, times price."""
    if rule == "booked":
        return (F.col(price) * F.col(ordered)).cast(MONEY_SUM)
    if rule == "view":
        qty = F.when(F.col(done) > 0, F.col(done)).otherwise(F.col(ordered))
        return (qty * F.col(price)).cast(MONEY_SUM)
    raise ValueError(rule)


def order_totals(lines: DataFrame, price: str, rule: str = "view") -> DataFrame:
    """Total per order (partial aggregation before the shuffle)."""
    return (lines.withColumn("_t", line_total(price, "ordered_qty", "done_qty", rule))
            .groupBy("order_id")
            .agg(F.count("*").alias("line_count"), exact_sum("_t", 2, MONEY_SUM).alias("order_total")))


def normalise_products(raw: DataFrame) -> DataFrame:
    """B2: product defaults as at creation: on hand null/0 -> 0, reserved 0
    when absent, free = on hand - reserved, unit 'Units', procure flag as a
    boolean (truthy), type '' when empty, vendor / BoM null when falsy."""
    from pyspark.sql import types as T
    cols = raw.columns

    def c(name, default=None):
        return F.col(name) if name in cols else F.lit(default)

    on_hand = or_default(c("on_hand_qty"), F.lit(0)).cast(QTY)
    reserved = F.coalesce(c("reserved_qty"), F.lit(0)).cast(QTY)
    flag = c("procure_on_demand")
    flag_t = raw.schema["procure_on_demand"].dataType if "procure_on_demand" in cols else T.BooleanType()
    if isinstance(flag_t, T.BooleanType):
        truthy = F.coalesce(flag, F.lit(False))
    elif isinstance(flag_t, T.StringType):
        truthy = F.coalesce(flag != "", F.lit(False))
    else:
        truthy = F.coalesce((flag != 0) & ~F.isnan(flag.cast("double")), F.lit(False))
    return raw.select(
        *[x for x in cols if x not in ("on_hand_qty", "reserved_qty", "unit", "procure_on_demand",
                                       "procurement_type", "vendor_id", "bom_id")],
        on_hand.alias("on_hand_qty"), reserved.alias("reserved_qty"),
        (on_hand - reserved).cast("decimal(15,3)").alias("free_to_use_qty"),
        or_default(c("unit"), "Units", "text").alias("unit"),
        truthy.alias("procure_on_demand"),
        or_default(c("procurement_type").cast("string"), "", "text").alias("procurement_type"),
        F.when(or_default(c("vendor_id"), F.lit(None)).isNotNull(), c("vendor_id")).alias("vendor_id"),
        F.when(or_default(c("bom_id"), F.lit(None)).isNotNull(), c("bom_id")).alias("bom_id"))


def set_where(df: DataFrame, predicate: Column, assignments: dict) -> DataFrame:
    """UPDATE ... SET ... WHERE as a projection: assigned columns take
    the new value where the predicate holds (null predicate = no change)."""
    out = {}
    for col, v in assignments.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out[col] = F.when(F.coalesce(predicate, F.lit(False)), val.cast(df.schema[col].dataType)).otherwise(F.col(col))
    return df.withColumns(out)


def with_vendor(orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Copy the vendor's name and address onto each order (left join on
    vendor id; AQE broadcasts the vendor side when it is small)."""
    v = vendors.select(F.col("id").alias("vendor_id"), "vendor_name", "vendor_address")
    return orders.drop(*[x for x in ("vendor_name", "vendor_address") if x in orders.columns]).join(v, "vendor_id", "left")


def append_rows(base: DataFrame, new: DataFrame) -> DataFrame:
    """add created rows (by column name; missing columns are null)."""
    return base.unionByName(new, allowMissingColumns=True)


def flatten(df: DataFrame, array_col: str, keep: list[str] | None = None) -> DataFrame:
    """child arrays back to rows (one row per element; parents with an
    empty array produce none)."""
    keep = keep if keep is not None else [c for c in df.columns if c != array_col]
    return df.select(*keep, F.explode(array_col).alias("_e")).select(*keep, "_e.*")


def line_totals(lines: DataFrame, price: str, rule: str = "view") -> DataFrame:
    """D19 per line: adds ``total`` by the booked or view rule (see
    ``line_total``); ``order_totals`` sums it per order."""
    return lines.withColumn("total", line_total(price, "ordered_qty", "done_qty", rule))
