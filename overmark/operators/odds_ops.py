"""Market-expectation operators over bookmaker quotes (D-06, D-06b) and the
home/away pivot of a long game table (J-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.odds import implied_prob


def home_away_pivot(sides: DataFrame, game_col: str = "game_id", flag: str = "is_home",
                    home_cols: dict[str, str] | None = None,
                    away_cols: dict[str, str] | None = None) -> DataFrame:
    """One row per game from one row per game and side.

    A self-join of the home rows to the away rows on the game key: a game
    with a missing side drops out and a duplicated side fans out, which an
    aggregate pivot would hide.  A NULL flag belongs to neither side.
    Both sides are hash-partitioned on the game key once.
    """
    home_cols = home_cols or {}
    away_cols = away_cols or {}
    h = sides.where(F.col(flag)).select(F.col(game_col).alias("_g"),
                                        *[F.col(k).alias(v) for k, v in home_cols.items()])
    a = sides.where(~F.col(flag)).select(F.col(game_col).alias("_g2"),
                                         *[F.col(k).alias(v) for k, v in away_cols.items()])
    return (h.join(a, h["_g"] == a["_g2"], "inner")
            .withColumnRenamed("_g", game_col).drop("_g2"))


def money_line_summary(quotes: DataFrame, zero: str = "zero") -> DataFrame:
    """Per (game, home team, away team): average prices and average implied
    probability per side, each rounded to 2 (convert, then average).

    The mean is rounded as a decimal of 9 places, so a mean of exactly half a
    hundredth goes up whatever its binary form."""
    def mean(value):
        return F.round(F.avg(value).cast("decimal(18,9)"), 2).cast("double")

    return (quotes.groupBy("game_id", "team_id", "a_team_id")
            .agg(mean("price1").alias("avg_money_line_price_home"),
                 mean("price2").alias("avg_money_line_price_away"),
                 mean(implied_prob("price1", zero)).alias("implied_win_prob_home"),
                 mean(implied_prob("price2", zero)).alias("implied_win_prob_away")))


def consensus_line(quotes: DataFrame, games: DataFrame, season_type: str = "Playoffs") -> DataFrame:
    """D-06: consensus money line of each playoff game.

    ``games`` is the pivoted game table (``home_away_pivot``).  The quote
    summary is an aggregate keyed by game, so both join sides arrive
    partitioned by ``game_id``.
    """
    ml = money_line_summary(quotes)
    g = games.where(F.col("season_type") == season_type)
    j = g.join(ml, "game_id", "inner")
    return j.select(
        F.col("game_id").cast("bigint").alias("game_id"),
        F.col("home_team_id").cast("bigint").alias("home_team_id"),
        F.col("away_team_id").cast("bigint").alias("away_team_id"),
        F.col("game_date").cast("date").alias("game_date"),
        F.col("matchup").cast("string").alias("matchup"),
        F.col("season_year").cast("bigint").alias("season_year"),
        F.col("season_type").cast("string").alias("season_type"),
        F.col("season").cast("string").alias("season"),
        F.col("home_wl").cast("string").alias("home_wl"),
        F.col("away_wl").cast("string").alias("away_wl"),
        F.col("implied_win_prob_home").cast("double").alias("implied_win_prob_home"),
        F.col("implied_win_prob_away").cast("double").alias("implied_win_prob_away"),
        F.col("avg_money_line_price_home").cast("double").alias("avg_money_line_price_home"),
        F.col("avg_money_line_price_away").cast("double").alias("avg_money_line_price_away"),
    )


def side_odds(quotes: DataFrame, zero: str = "one", single_scan: bool = True) -> DataFrame:
    """D-06b: long-form market expectation, one row per (game, side team):
    average the side's prices, then convert the average to a probability.

    ``single_scan=True`` reads the quotes once and unpivots each quote into
    its two sides (``explode`` of a two-element array) before one aggregate;
    the side tag stays in the key so a team quoted as home in one quote and
    away in another keeps two rows, as with a UNION ALL of two aggregates.
    """
    if single_scan:
        long = quotes.select(
            "game_id",
            F.explode(F.array(
                F.struct(F.lit(0).alias("side"), F.col("team_id").alias("target_team_id"),
                         F.col("price1").alias("price")),
                F.struct(F.lit(1).alias("side"), F.col("a_team_id").alias("target_team_id"),
                         F.col("price2").alias("price")))).alias("s"))
        agg = (long.groupBy("game_id", "s.side", "s.target_team_id")
               .agg(F.avg("s.price").alias("avg_price"))
               .drop("side"))
    else:
        home = quotes.groupBy("game_id", F.col("team_id").alias("target_team_id")).agg(
            F.avg("price1").alias("avg_price"))
        away = quotes.groupBy("game_id", F.col("a_team_id").alias("target_team_id")).agg(
            F.avg("price2").alias("avg_price"))
        agg = home.unionByName(away)
    return agg.select("game_id", "target_team_id", "avg_price",
                      implied_prob("avg_price", zero).alias("implied_win_prob"))
