"""Cumulative aggregates per key as a prefix scan over range pieces.

A plain window sorts all rows of a key in one task, so a key with a third of
the data is one task with a third of the data.  Here the rows are cut by
range of (keys, order) into pieces of about ``piece_rows`` rows, wherever the
borders fall: a hot key covers many pieces, small keys share one.  Equal
(keys, order) rows fall into the same piece.

1. The ranged rows are written once with their piece, so every later step
   sees the same borders, also after a lost executor.
2. Each (piece, key) is summed; a window over these few rows gives what a key
   brings along from earlier pieces.  Pieces are ordered by key first, so only
   the first key of a piece can come from an earlier one: the carry has at
   most one row a piece.
3. The window runs within (piece, key) and the carry is added.

With ``frame="range"`` rows of equal order are peers and share their value.
They are summed to one row first (a map-side aggregate, so any number of
peers is fine), scanned like above and joined back by (keys, order).

NULL keys are one key and NULL order values sort first, as in SQL; sums skip
NULLs and are NULL until the first value; an empty input gives no rows.  The
number of pieces comes from the row count; there is one path at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import materialize

PIECE_ROWS = 1_000_000
CARRY_BROADCAST = 100_000       # carry rows (one a piece at most) up to which the carry is broadcast


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def join_null_safe(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL, as in a window's partition."""
    side = small.select(*[F.col(k).alias(f"_ns_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_ns_{k}")) for k in keys]
    return big.join(side, cond, how).drop(*[f"_ns_{k}" for k in keys])


def pieces(df: DataFrame, keys: list[str], order: list, piece_rows: int, name: str = "_piece") -> tuple[DataFrame, int]:
    """(``df`` cut by range of (keys, order) with its piece number, written
    and read back; number of pieces)."""
    n = max(1, math.ceil(df.count() / piece_rows))
    ranged = df.repartitionByRange(n, *[_col(k) for k in keys], *[_col(o) for o in order])
    return materialize(ranged.withColumn(name, F.spark_partition_id()), "range_pieces"), n


def _agg(fn: str, c: Column) -> Column:
    if fn == "sum":
        return F.sum(c)
    if fn == "count":
        return F.count(c)
    raise ValueError(fn)


def _scan_rows(df: DataFrame, keys: list[str], order: list, vals: dict[str, tuple[str, str]],
               piece_rows: int) -> DataFrame:
    """ROWS UNBOUNDED PRECEDING .. CURRENT ROW of ``vals`` (out → (fn, column))."""
    base, n = pieces(df, keys, order, piece_rows)
    totals = base.groupBy("_piece", *keys).agg(*[_agg(fn, F.col(c)).alias(f"_t_{o}") for o, (fn, c) in vals.items()])
    by_key = W.partitionBy(*keys).orderBy("_piece")
    before = by_key.rowsBetween(W.unboundedPreceding, -1)
    carry = (totals.select("_piece", *keys, F.lag("_piece").over(by_key).alias("_before"),
                           *[F.sum(f"_t_{o}").over(before).alias(f"_o_{o}") for o in vals])
             .where(F.col("_before").isNotNull()).drop("_before"))
    if n <= CARRY_BROADCAST:
        carry = F.broadcast(carry)
    within = W.partitionBy("_piece", *keys).orderBy(*[_col(o) for o in order]).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    res = base.withColumns({f"_i_{o}": _agg(fn, F.col(c)).over(within) for o, (fn, c) in vals.items()})
    res = join_null_safe(res, carry, ["_piece", *keys])
    outs = {}
    for o, (fn, _) in vals.items():
        i, off = F.col(f"_i_{o}"), F.col(f"_o_{o}")
        both = F.coalesce(i, F.lit(0)) + F.coalesce(off, F.lit(0))
        outs[o] = F.when(i.isNotNull() | off.isNotNull(), both) if fn == "sum" else both
    return res.withColumns(outs).drop("_piece", *[f"_{p}_{o}" for o in vals for p in ("i", "o")])


def running_aggs(df: DataFrame, keys: list[str], order: list, specs: dict[str, tuple[str, Column | str]],
                 frame: str = "rows", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Cumulative aggregates per ``keys`` in ``order``, several at once.

    ``specs`` maps output name → (fn, value) with fn ``"sum"`` or
    ``"count"``.  ``frame="rows"`` is UNBOUNDED PRECEDING → CURRENT ROW over a
    total order; ``frame="range"`` includes peers (rows with equal order
    values), the SQL default frame, and takes order columns by name.
    """
    if frame not in ("rows", "range"):
        raise ValueError(frame)
    vals = {o: (fn, f"_v_{o}") for o, (fn, _) in specs.items()}
    if frame == "rows":
        # a column of the rows is read where it stands: a copy would be dealt and written with every row
        own = {o: v for o, (_, v) in specs.items() if isinstance(v, str) and v in df.columns and v not in specs}
        vals.update({o: (specs[o][0], v) for o, v in own.items()})
        copied = {f"_v_{o}": _col(v) for o, (_, v) in specs.items() if o not in own}
        base = df.withColumns(copied) if copied else df
        return _scan_rows(base, keys, order, vals, piece_rows).drop(*copied)
    base = df.withColumns({f"_v_{o}": _col(v) for o, (_, v) in specs.items()})
    if not all(isinstance(o, str) for o in order):
        raise ValueError("a range frame takes order columns by name")
    peers = base.groupBy(*keys, *order).agg(*[_agg(fn, F.col(c)).alias(c) for fn, c in vals.values()])
    scanned = _scan_rows(peers, keys, order, {o: ("sum", c) for o, (_, c) in vals.items()}, piece_rows)
    return join_null_safe(df, scanned.select(*keys, *order, *vals), [*keys, *order])


def running_sum(df, keys, order, value, out, frame="rows", piece_rows=PIECE_ROWS):
    return running_aggs(df, keys, order, {out: ("sum", value)}, frame, piece_rows)


def running_count(df, keys, order, out, frame="rows", piece_rows=PIECE_ROWS):
    return running_aggs(df, keys, order, {out: ("count", F.lit(1))}, frame, piece_rows)


def running_avg(df, keys, order, value, out, frame="rows", piece_rows=PIECE_ROWS):
    """Cumulative average = running sum / running count of non-null values."""
    r = running_aggs(df, keys, order, {f"_s_{out}": ("sum", value), f"_c_{out}": ("count", value)}, frame, piece_rows)
    return (r.withColumn(out, F.try_divide(F.col(f"_s_{out}"), F.col(f"_c_{out}").cast("double")))
            .drop(f"_s_{out}", f"_c_{out}"))


def dense_rank_table(df: DataFrame, keys: list[str], order_col: str, out: str,
                     piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(keys, order value) → ``dense_rank`` within keys: a running count over
    the distinct pairs, carried across pieces where one key has more distinct
    values than a piece holds.  NULL order values rank first, as in SQL."""
    ranked = running_count(df.select(*keys, order_col).distinct(), keys, [order_col], out, piece_rows=piece_rows)
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def dense_rank_by(df: DataFrame, keys: list[str], order_col: str, out: str,
                  piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``dense_rank() over (partition by keys order by order_col)``: the rank
    table joined back."""
    return join_null_safe(df, dense_rank_table(df, keys, order_col, out, piece_rows), [*keys, order_col])
