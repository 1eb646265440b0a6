"""Aggregate building blocks that hold up under skew; the cumulative windows
are in ``prefix``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prefix import (dense_rank_by, dense_rank_table, running_aggs, running_avg, running_count,  # noqa: F401
                     running_sum)


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def last_non_null(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: ``value`` at the greatest ``order`` among rows where value
    is not NULL (ties: any).  Partial-aggregated map side."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.struct(*_cols(order)) if len(order) > 1 else _cols(order)[0]
    return F.max_by(v, F.when(v.isNotNull(), o))
