"""Joins of points with validity intervals, and lookups with fallbacks.

``interval_join`` matches equal keys and a point inside [lo, hi].  On the
keys alone every row would meet every interval of its key; with a range
condition only, every interval would have to be broadcast.  Here the interval
table is exploded into cells of ``cell`` units, the point falls into one cell,
and the join is an equi-join on (keys, cell) with the range as residual: it
shuffles, skews and spills like any other equi-join, and a pair meets in one
cell only, so nothing has to be deduplicated.  An interval costs
(hi - lo) / cell + 1 small rows.

``ranked_lookup`` folds all candidates of a key into one row before anything
is joined, so the fact table is joined once, by a unique key, and keeps its
row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 8


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, str]], point: Column,
                  lo: str, hi: str, how: str = "left", cell: int = CELL) -> DataFrame:
    """``left`` joined with the rows of ``right`` whose key columns equal and
    whose [lo, hi] holds ``point``.

    ``keys`` pairs an expression on ``left`` with a column of ``right``; key
    and interval columns of ``right`` are dropped from the result.  A NULL
    point, key or interval end matches nothing (with ``how="left"`` the row
    stays, with NULLs); make a point NULL to keep a row from being matched.
    Overlapping intervals give a row each, as in SQL.
    """
    names = [f"_ij_k{i}" for i in range(len(keys))]
    cells = F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    rest = [c for c in right.columns if c not in {lo, hi, *[k for _, k in keys]}]
    # lo <= hi also drops NULL ends, which match nothing
    r = right.where(F.col(lo) <= F.col(hi)).select(
        *[F.col(k).alias(f"{n}_r") for n, (_, k) in zip(names, keys, strict=True)],
        F.col(lo).alias("_ij_lo"), F.col(hi).alias("_ij_hi"), *rest, F.explode(cells).alias("_ij_cell_r"))
    p = left.withColumns({**{n: e for n, (e, _) in zip(names, keys, strict=True)}, "_ij_at": point})
    p = p.withColumn("_ij_cell", F.floor(F.col("_ij_at") / cell))
    cond = (F.col("_ij_cell") == F.col("_ij_cell_r")) & F.col("_ij_at").between(F.col("_ij_lo"), F.col("_ij_hi"))
    for n in names:
        cond = cond & (F.col(n) == F.col(f"{n}_r"))
    return p.join(r, cond, how).drop(*names, *[f"{n}_r" for n in names], "_ij_at", "_ij_cell", "_ij_cell_r",
                                     "_ij_lo", "_ij_hi")


def ranked_lookup(candidates: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """One row a key: ``value`` of the first of ``candidates`` that has a
    non-NULL one for the key (ties within one: the smallest).  Candidates are
    tables (keys, value), best first; they are folded by one aggregate."""
    ranked = None
    for rank, c in enumerate(candidates):
        c = c.select(*keys, F.col(value).alias(value), F.lit(rank).alias("_rank"))
        ranked = c if ranked is None else ranked.unionByName(c)
    order = F.when(F.col(value).isNotNull(), F.struct("_rank", value))
    return ranked.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def cascade(df: DataFrame, levels: list[tuple[list[tuple[Column, str]], DataFrame, str]], out: str) -> DataFrame:
    """``out`` from the first of several lookups that matches a row.

    A level is (key pairs, lookup table, its value column).  Each lookup is
    folded to one row a key first (smallest value), so every row of ``df``
    stays one row; a level is asked only where all earlier ones missed.  A
    match counts even if its value is NULL.
    """
    hit, value = F.lit(False), None
    helpers = []
    for i, (keys, table, col) in enumerate(levels):
        names = [f"_c{i}_k{j}" for j in range(len(keys))]
        one = table.select(*[F.col(k).alias(n) for n, (_, k) in zip(names, keys, strict=True)],
                           F.col(col).alias(f"_c{i}_v")).groupBy(*names).agg(
            F.min(f"_c{i}_v").alias(f"_c{i}_v"), F.lit(True).alias(f"_c{i}_hit"))
        cond = ~hit
        for n, (e, _) in zip(names, keys, strict=True):
            cond = cond & (e == F.col(n))
        df = df.join(one, cond, "left")
        hit = hit | F.coalesce(F.col(f"_c{i}_hit"), F.lit(False))
        value = F.col(f"_c{i}_v") if value is None else F.coalesce(value, F.col(f"_c{i}_v"))
        helpers += [*names, f"_c{i}_v", f"_c{i}_hit"]
    return df.withColumn(out, value).drop(*helpers)
