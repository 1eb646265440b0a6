"""Column helpers that pin warehouse-style NULL and cast semantics on Spark.

Every helper returns a JVM-side ``Column`` expression, so it stays inside
whole-stage codegen.  Names follow the contract they implement, not the
Spark function they happen to use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_cast(x: ColumnOrName, to: str) -> Column:
    """Cast that yields NULL instead of raising (``'12.0'`` → bigint is NULL)."""
    x = _c(x)
    if to in ("bool", "boolean"):
        return safe_bool(x)
    return x.try_cast(to)


def safe_bool(x: ColumnOrName) -> Column:
    """String → boolean accepting only ``true``/``false`` (any case)."""
    s = F.lower(F.trim(_c(x).cast("string")))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def round_cast(x: ColumnOrName, strip_plus: bool = False) -> Column:
    """Parse as double, round half away from zero, then to bigint.

    A bare double→bigint cast truncates in Spark, so the round comes first.
    """
    x = _c(x).cast("string")
    if strip_plus:
        x = F.replace(x, F.lit("+"), F.lit(""))
    return F.round(x.try_cast("double")).try_cast("bigint")


def hard_cast(x: ColumnOrName, to: str) -> Column:
    """Cast that raises on malformed input (ANSI)."""
    return _c(x).cast(to)


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NULL when b is 0 or either side is NULL."""
    return F.try_divide(_c(a), _c(b))


def least_nn(*cols: ColumnOrName) -> Column:
    """``least`` that is NULL when any argument is NULL (Spark skips NULLs)."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.least(*cs))


def greatest_nn(*cols: ColumnOrName) -> Column:
    """``greatest`` that is NULL when any argument is NULL."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.greatest(*cs))


def slug(x: ColumnOrName) -> Column:
    """Lower-case and drop every character outside ``[a-z0-9]``."""
    return F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]", "")


def extract_digits(x: ColumnOrName) -> Column:
    """First run of digits as bigint; NULL when there is none."""
    m = F.regexp_extract(_c(x), r"\d+", 0)
    return F.when(m != "", m.try_cast("bigint"))


def parse_date(x: ColumnOrName, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict date parse; NULL on malformed input (``'2020-1-1'`` is NULL)."""
    return F.try_to_date(_c(x), fmt)


def null_if_sentinel(x: ColumnOrName, sentinel: str = "N/A", to: str = "double") -> Column:
    """``if(x = sentinel, NULL, safe_cast(x))``; a NULL input stays NULL."""
    x = _c(x)
    return F.when(x != F.lit(sentinel), x.try_cast(to))


def label_cleanup(x: ColumnOrName) -> Column:
    """Drop the ``'- '`` separator from a round label (NULL-safe)."""
    return F.replace(_c(x), F.lit("- "), F.lit(""))


def game_number_fix(x: ColumnOrName) -> Column:
    """Any value containing a ``1`` becomes ``'1'``, then a hard double cast.

    Faithful to the reference: ``'10'`` and ``'11'`` also map to 1.
    """
    x = _c(x)
    return F.when(x.like("%1%"), F.lit("1")).otherwise(x).cast("double")


def normalize_key(x: ColumnOrName, case: str = "upper") -> Column:
    """Trimmed, case-folded match key."""
    t = F.trim(_c(x).cast("string"))
    return F.upper(t) if case == "upper" else F.lower(t)


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``(first or '') + ' ' + (last or '')`` stripped."""
    return F.trim(F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "),
                           F.coalesce(_c(last), F.lit(""))))


def remap_values(x: ColumnOrName, mapping: dict) -> Column:
    """Equality remap through a small literal table; other values pass."""
    x = _c(x)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(x == F.lit(k), F.lit(v)) if expr is None
                else expr.when(x == F.lit(k), F.lit(v)))
    return x if expr is None else expr.otherwise(x)


def round_to_step(x: ColumnOrName, step: float = 5.0) -> Column:
    """Round to the nearest multiple of ``step`` (half away from zero)."""
    return F.round(_c(x) / F.lit(step), 0) * F.lit(step)


def element0(arr: ColumnOrName, i: int) -> Column:
    """0-based, NULL-safe array access (``a[safe_offset(i)]``)."""
    return F.get(_c(arr), F.lit(i))


def slice0(arr: ColumnOrName, start0: int, length: int = 99) -> Column:
    """0-based ``array_slice(a, start, start+length-1)``; empty past the end."""
    return F.slice(_c(arr), start0 + 1, length)
