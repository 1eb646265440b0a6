"""Betting price ↔ probability conversions as Column expressions.

Three zero-price conventions exist in the reference models and all three are
kept, selected by ``zero=``:

* ``"one"``  – test ``price < 0`` first; a price of 0 gives 1.0.
* ``"zero"`` – test ``price > 0`` first with safe division; 0 gives 0.0.
* ``"null"`` – explicit sign tests; 0 (and NULL) give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import ColumnOrName, _c, round_to_step, safe_divide


def implied_prob(price: ColumnOrName, zero: str = "one") -> Column:
    p = _c(price)
    hundred = F.lit(100.0)
    if zero == "one":
        return F.when(p < 0, F.abs(p) / (F.abs(p) + hundred)).otherwise(hundred / (p + hundred))
    if zero == "zero":
        return (F.when(p > 0, safe_divide(hundred, p + hundred))
                .otherwise(safe_divide(F.abs(p), F.abs(p) + hundred)))
    if zero == "null":
        return (F.when(p.isNull(), F.lit(None).cast("double"))
                .when(p < 0, safe_divide(F.abs(p), F.abs(p) + F.lit(100)))
                .when(p > 0, safe_divide(F.lit(100), p + F.lit(100))))
    raise ValueError(f"unknown zero-price convention: {zero!r}")


def american_price(prob: ColumnOrName, step: float = 5.0) -> Column:
    """Win probability → American price on a ``step`` grid.

    NULL outside the open interval (0, 1); favourites (p ≥ 0.5) get a
    negative price.
    """
    p = _c(prob)
    one = F.lit(1)
    return (F.when(p.isNull() | (p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p >= 0.5, round_to_step(F.lit(-100) * safe_divide(p, one - p), step))
            .otherwise(round_to_step(F.lit(100) * safe_divide(one - p, p), step)))


def side_american_price(prob: ColumnOrName, is_team_side: Column, is_opp_side: Column,
                        step: float = 5.0) -> Column:
    """Price from one side's point of view: the team side prices ``p``, the
    opponent side prices ``1 - p``; NULL when neither side matches."""
    p = _c(prob)
    q = F.lit(1) - p
    return (F.when(p.isNull() | (p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(is_team_side & (p >= 0.5), round_to_step(F.lit(-100) * safe_divide(p, q), step))
            .when(is_team_side & (p < 0.5), round_to_step(F.lit(100) * safe_divide(q, p), step))
            .when(is_opp_side & (q >= 0.5), round_to_step(F.lit(-100) * safe_divide(q, p), step))
            .when(is_opp_side & (q < 0.5), round_to_step(F.lit(100) * safe_divide(p, q), step)))


def logit(prob: ColumnOrName) -> Column:
    """``ln(p / (1 - p))`` with safe division; NULL for p outside (0, 1)."""
    p = _c(prob)
    r = safe_divide(p, F.lit(1) - p)
    return F.when(r > 0, F.log(r))
