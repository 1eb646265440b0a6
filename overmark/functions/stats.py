"""Statistical functions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)), to about 13 digits at any z; NULL for NULL.

    Below 3 from the series Phi(a) - 1/2 = phi(a) (a + a^3/3 + a^5/15 + ...),
    from there on by the continued fraction of the upper tail,
    phi(a) / (a + 1/(a + 2/(a + 3/(a + ...)))), which keeps its relative
    precision where the series would cancel."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    term = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), term(a, a),
        lambda x, k: let(x["t"] * a * a / (2 * k + 1), lambda t: term(t, x["s"] + t)), lambda x: x["s"])
    tail = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), a, lambda t, k: a + k / t)
    return F.when(a < 3, 1 - 2 * density * series).when(a >= 3, 2 * density / tail)
