"""Series-level operators: first game, format, win probability, result
(D-08, D-09, D-10, D-18).

All group keys here are one series (and side): a handful of games times the
players in them, never a whole league or career, so per-series aggregates
and windows are bounded however large the input grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.odds import american_price

SIDE_KEYS = ["series_id", "player_team_id", "opponent_team_id"]


def first_game_per_series(df: DataFrame, keys=SIDE_KEYS,
                          order=("series_game_number", "game_ts", "kaggle_game_id", "person_id"),
                          cols=None) -> DataFrame:
    """D-10: the first game row of each (series, side, opponent), ordered by
    game number, time, id (NULLs first).  A partial-aggregated ``min_by`` over
    the order struct, so there is no per-group sort.  Teammates in the same
    first game tie on those keys; ``person_id`` breaks the tie so the
    player-level ``series_start_ts`` carried along is deterministic."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    pick = F.min_by(F.struct(*[F.col(c) for c in cols]),
                    F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(pick.alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in cols])


def with_series_format(df: DataFrame, year_col="year_id", label_col="game_label") -> DataFrame:
    """D-08: wins needed and venue schedule by era and round label."""
    return df.withColumns({
        "required_series_wins": S.series_required_wins(year_col, label_col),
        "home_schedule": S.series_schedule(year_col, label_col),
    })


def series_odds(first_games: DataFrame, mirror_venue: bool = False) -> DataFrame:
    """D-09: series win probability of each side from its game-1 forecast,
    venue flag and the era's schedule — one Column, no path enumeration."""
    f = with_series_format(first_games)
    return f.select(
        "year_id", *SIDE_KEYS, "series_start_ts",
        S.series_forecast("home_schedule", "player_game_forecast", "player_home",
                          "required_series_wins", mirror_venue).alias("series_forecast"))


def series_odds_enumerated(first_games: DataFrame) -> DataFrame:
    """D-09, literal form: enumerate all 2^n win/loss paths per side, carry
    running win counts, find each side's clinch game, and sum the
    probabilities of the paths the player's side clinches first.

    Kept as a cross-check of ``series_odds``; it emits n·2^n rows per side
    (896 for best of 7), so it is for validation, not production.
    A zero path probability is a product, never exp(sum(ln)).
    """
    f = with_series_format(first_games)
    n = F.size("home_schedule")
    g = f.select("year_id", *SIDE_KEYS, "series_start_ts", "required_series_wins",
                 n.alias("max_series_games"),
                 F.posexplode(S.scheduled_probs("home_schedule", "player_game_forecast", "player_home"))
                 .alias("game_offset", "q"))
    g = g.withColumn("game_number", F.col("game_offset") + 1)
    paths = g.withColumn("path_number", F.explode(F.sequence(F.lit(0), F.pow(2, F.col("max_series_games")).cast("int") - 1)))
    bit = F.expr("cast((path_number div cast(pow(2, max_series_games - game_number) as int)) % 2 as int)")
    paths = paths.withColumn("player_win_bit", bit)
    pk = [*SIDE_KEYS, "path_number"]
    w = W.partitionBy(*pk).orderBy("game_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    paths = paths.withColumns({
        "running_player_wins": F.sum("player_win_bit").over(w),
        "running_opponent_wins": F.sum(F.lit(1) - F.col("player_win_bit")).over(w),
    })
    need = F.col("required_series_wins")
    per_path = (paths.groupBy("year_id", *SIDE_KEYS, "series_start_ts", "required_series_wins", "path_number")
                .agg(F.product(F.when(F.col("player_win_bit") == 1, F.col("q"))
                               .otherwise(F.lit(1) - F.col("q"))).alias("path_probability"),
                     F.min(F.when((F.col("running_player_wins") == need)
                                  & (F.col("running_opponent_wins") < need), F.col("game_number")))
                     .alias("player_clinch_game"),
                     F.min(F.when((F.col("running_opponent_wins") == need)
                                  & (F.col("running_player_wins") < need), F.col("game_number")))
                     .alias("opponent_clinch_game")))
    pc, oc = F.col("player_clinch_game"), F.col("opponent_clinch_game")
    return (per_path.where(pc.isNotNull() | oc.isNotNull())
            .groupBy("year_id", *SIDE_KEYS, "series_start_ts")
            .agg(F.sum(F.when(pc.isNotNull() & (oc.isNull() | (pc < oc)), F.col("path_probability"))
                       .otherwise(F.lit(0.0))).alias("series_forecast")))


def series_results(games: DataFrame) -> DataFrame:
    """D-18 part 1: per (series, side, opponent, year) over the distinct team
    games: games, wins each way, and the majority outcome (1/0, NULL on a
    tie).  The distinct games are a set per series, which is reduced map side
    and dealt once, by series; its games are counted where they are."""
    d = (games.groupBy(*SIDE_KEYS, F.col("year_id").try_cast("bigint").alias("year_id"))
         .agg(F.collect_set(F.struct("kaggle_game_id", "series_start_ts", "player_win")).alias("_games"))
         .select(*SIDE_KEYS, "year_id", F.inline("_games")))
    wins, losses = F.sum("player_win"), F.sum(F.lit(1) - F.col("player_win"))
    return (d.groupBy(*SIDE_KEYS, "year_id")
            .agg(F.min("series_start_ts").alias("series_start_ts"),
                 F.count_distinct("kaggle_game_id").alias("team_series_games"),
                 wins.alias("team_series_wins"),
                 losses.alias("opponent_series_wins"),
                 F.when(wins > losses, 1).when(wins < losses, 0).alias("series_win")))


def series_residuals(results: DataFrame, odds: DataFrame) -> DataFrame:
    """D-18 part 2: attach the series forecast, its price, and the residual
    (result − forecast, rounded to 4)."""
    o = odds.select(*SIDE_KEYS, "year_id", "series_forecast")
    j = results.join(o, [*SIDE_KEYS, "year_id"], "left")
    return j.select(
        "year_id", *SIDE_KEYS, "series_start_ts", "team_series_games", "team_series_wins",
        "opponent_series_wins", "series_win", "series_forecast",
        american_price("series_forecast").alias("series_money_line"),
        F.round(F.col("series_win").cast("double") - F.col("series_forecast"), 4).alias("series_residual"))
