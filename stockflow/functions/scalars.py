"""Scalar column functions: Column(s) in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "reference_code", "clean_text", "coerce_value", "date_only", "add_days",
    "norm_email", "or_default", "at_least", "at_most", "to_document", "availability",
    "contains_ci", "contains", "char_length", "null_to_empty", "nan_to_null", "exact", "exact_sum",
]

# Separators and class used by the text cleaner (every Unicode
# white space, since Java's \s misses U+00A0 and friends).
_WS = r"[\s\p{Z}\x{FEFF}]+"
# JavaScript Number() literals: decimal with optional exponent, radix forms
# without a sign, and (signed) Infinity; surrounding white space is allowed.
_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_RADIX = {"x": (r"^\s*0[xX]([0-9a-fA-F]+)\s*$", 16), "b": (r"^\s*0[bB]([01]+)\s*$", 2),
          "o": (r"^\s*0[oO]([0-7]+)\s*$", 8)}
_INFINITY = r"^\s*([+-]?)Infinity\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reference_code(prefix, n) -> Column:
    """G1: prefix + '-' + n zero-padded to 6 digits; longer numbers are kept
    whole (format_string, not lpad, which would truncate)."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string("%s-%06d", p, _col(n).cast("long"))


def clean_text(s, max_len: int = 500) -> Column:
    """Drop '<' and '>', collapse white space, trim, cut to max_len."""
    c = F.coalesce(_col(s).cast("string"), F.lit(""))
    c = F.regexp_replace(c, "[<>]", "")
    c = F.regexp_replace(c, _WS, " ")
    c = F.regexp_replace(c, r"^ | $", "")
    return F.substring(c, 1, max_len)


def coerce_value(key, value) -> Column:
    """Form-value coercion as a struct(kind, text, number, flag).

    '' -> null; 'true'/'false' -> boolean; numeric text -> number unless the
    key contains 'date' or is password / email; else the text itself.
    """
    k, v = _col(key), _col(value)
    looks_numeric = v.rlike(_NUMERIC) | v.rlike(_INFINITY)
    for pattern, _ in _RADIX.values():
        looks_numeric = looks_numeric | v.rlike(pattern)
    numeric_ok = (looks_numeric & ~F.coalesce(k.contains("date"), F.lit(False))
                  & ~k.isin("password", "email"))
    number = F.when(v.rlike(_NUMERIC), F.trim(v).try_cast("double"))
    for pattern, base in _RADIX.values():
        number = number.when(v.rlike(pattern), F.conv(F.regexp_extract(v, pattern, 1), base, 10).try_cast("double"))
    number = number.when(v.rlike(_INFINITY), F.when(F.regexp_extract(v, _INFINITY, 1) == "-", F.lit(float("-inf")))
                         .otherwise(F.lit(float("inf"))))
    kind = (F.when(v.isNull() | (v == ""), "null")
             .when(v.isin("true", "false"), "boolean")
             .when(numeric_ok, "number")
             .otherwise("text"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "text", v).alias("text"),
        F.when(kind == "number", number).alias("number"),
        F.when(kind == "boolean", v == "true").alias("flag"))


def date_only(v) -> Column:
    """First 10 characters of a date-like value, '' for empty / null."""
    s = _col(v).cast("string")
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.substring(s, 1, 10))


def add_days(as_of, n: int) -> Column:
    """Date arithmetic against an explicit as-of date."""
    d = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else _col(as_of)
    return F.date_add(d, n)


def norm_email(s) -> Column:
    """Trim + lower case."""
    return F.lower(F.trim(_col(s)))


def nan_to_null(x) -> Column:
    """NaN becomes null (JS comparisons with NaN are false, Spark's max and
    greatest would return NaN instead)."""
    c = _col(x)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def or_default(a, b, kind: str = "number") -> Column:
    """A unless it is falsy in JavaScript, then b (`a || b`).

    kind 'number': null, 0, NaN are falsy; 'text': null, ''; 'bool': null, false.
    """
    c = _col(a)
    default = F.lit(b) if isinstance(b, (int, float, str, bool)) else _col(b)
    if kind == "number":
        falsy = c.isNull() | F.isnan(c.cast("double")) | (c == 0)
    elif kind == "text":
        falsy = c.isNull() | (c == "")
    elif kind == "bool":
        falsy = c.isNull() | ~c
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return F.when(falsy, default).otherwise(c)


def at_least(x, lo=0) -> Column:
    """Clamp from below (greatest skips nulls)."""
    return F.greatest(_col(x), F.lit(lo) if not isinstance(lo, Column) else lo)


def at_most(x, hi) -> Column:
    """Clamp from above (least skips nulls)."""
    return F.least(_col(x), _col(hi) if not isinstance(hi, (int, float)) else F.lit(hi))


def to_document(*cols, keep_nulls: bool = True) -> Column:
    """A JSON object text of the given columns; nulls kept as null."""
    opts = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*[_col(c) for c in cols]), opts)


def availability(ordered, on_hand, reserved, mode: str = "sales") -> Column:
    """Read-time availability.

    mode 'sales': 'Shortage' when ordered > on_hand - reserved, else 'Available'.
    mode 'mo':    'Available' when on_hand - reserved >= need, else 'Not Available'.
    A null comparison falls to the else branch, as SQL CASE does.
    """
    free = _col(on_hand) - _col(reserved)
    if mode == "sales":
        return F.when(_col(ordered) > free, "Shortage").otherwise("Available")
    if mode == "mo":
        return F.when(free >= _col(ordered), "Available").otherwise("Not Available")
    if mode == "snapshot":
        return F.when(free >= _col(ordered), "Available").otherwise("Shortage")
    raise ValueError(f"unknown availability mode {mode!r}")


def contains_ci(c, term: str) -> Column:
    """Case-insensitive substring test; null field -> false."""
    return F.coalesce(F.lower(_col(c).cast("string")).contains(term.lower()), F.lit(False))


def contains(c, term: str) -> Column:
    """Case-sensitive substring test; null field -> false."""
    return F.coalesce(_col(c).cast("string").contains(term), F.lit(False))


def char_length(c) -> Column:
    """G13."""
    return F.char_length(_col(c))


def null_to_empty(c) -> Column:
    """Audit values: null -> '' else the text form."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def exact(c) -> Column:
    """A number as decimal(30,10), for sums without loss: decimals keep their
    digits, doubles their shortest decimal text. A value that needs more than
    10 fractional digits (or does not fit) fails the query; nothing is cut."""
    v = _col(c)
    d = v.cast("decimal(30,10)")
    return F.when(v.isNull() | (d == v), d).otherwise(
        F.raise_error(F.lit("value does not fit decimal(30,10)")).cast("decimal(30,10)"))


def exact_sum(c, scale: int = 3, out: str | None = None) -> Column:
    """Sum of ``exact`` values; only the total is rounded, to ``scale`` digits."""
    return F.sum(exact(c)).cast(out or f"decimal(18,{scale})")
