"""Outcome-minus-expectation residuals per participant (D-16, D-17, D-19,
D-20, D-22) and the player-game base they are computed from.

Scale notes.  A participant's career is the hot key: one star can hold a
large share of all rows.  Career-level results therefore never sort a whole
career in one task:

* running sums use the two-level window of ``common.running_sum``;
* "last value" and "max" bounds are partial-aggregated ``max_by`` / ``max``;
* per-participant tables are brought to the participant's series or years
  first and joined on these, never on the participant alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.odds import side_american_price
from ..functions.series import series_key
from .common import last_non_null
from .prefix import PIECE_ROWS, running_aggs, running_sum

# Career order of a person's series: start time and id, then the season
# and sides so that the order is total even when one series id spans two
# seasons (a tie the warehouse model leaves to chance).
SERIES_ORDER = ["series_start_ts", "series_id", "year_id", "player_team_id", "opponent_team_id"]

STAT_COLS = ["num_minutes", "points", "assists", "rebounds_total", "blocks", "steals",
             "field_goals_attempted", "field_goals_made", "turnovers"]


def raw_player_games(stats: DataFrame, game_type: str = "Playoffs") -> DataFrame:
    """Playoff box-score rows with the long series key, time columns and
    the parsed game number."""
    ts = F.col("game_date_time_est").cast("timestamp")
    return (stats.where(F.col("game_type") == game_type)
            .select("person_id", "first_name", "last_name", "game_id", *STAT_COLS,
                    "field_goals_percentage" if "field_goals_percentage" in stats.columns
                    else F.lit(None).cast("double").alias("field_goals_percentage"),
                    F.col("player_team_id").cast("bigint").alias("player_team_id"),
                    F.col("opponent_team_id").cast("bigint").alias("opponent_team_id"),
                    F.col("player_home").cast("bigint").alias("player_home"),
                    "game_label", "game_date_time_est",
                    ts.alias("game_ts"), F.to_date(ts).alias("game_date"),
                    series_key(ts, "game_label", "player_team_id", "opponent_team_id").alias("series_id"),
                    safe.extract_digits(F.col("series_game_number").cast("string")).alias("series_game_number")))


def dedup_player_game(raw: DataFrame) -> DataFrame:
    """O-08: one row per (person, game): box-score sums, field-goal ratio of
    the sums, any non-null value of each attribute."""
    anyv = lambda c: F.any_value(c, True).alias(c)
    return (raw.groupBy("person_id", "game_id")
            .agg(anyv("first_name"), anyv("last_name"),
                 *[F.sum(c).alias(c) for c in STAT_COLS if c != "turnovers"],
                 safe.safe_divide(F.sum("field_goals_made"), F.sum("field_goals_attempted"))
                 .alias("field_goals_percentage"),
                 F.sum("turnovers").alias("turnovers"),
                 *[anyv(c) for c in ("player_team_id", "opponent_team_id", "player_home", "game_label",
                                     "game_date_time_est", "game_ts", "game_date", "series_id",
                                     "series_game_number")]))


def with_series_start(df: DataFrame) -> DataFrame:
    """W-01: first game time of each (person, series) — a window over one
    person's games in one series (at most a best-of-7)."""
    w = W.partitionBy("person_id", "series_id")
    return df.withColumn("series_start_ts", F.min("game_ts").over(w))


def eligible_persons(df: DataFrame, min_series: int = 10, min_minutes: float | None = None,
                     series_col: str = "series_id", minutes_col: str = "series_minutes") -> DataFrame:
    """D-22: persons with more than ``min_series`` distinct series [and more
    than ``min_minutes`` minutes].  count(DISTINCT) is planned as a two-level
    aggregate (person, series) → person, so a hot person is pre-reduced map
    side."""
    aggs = [F.count_distinct(series_col).alias("career_playoff_series")]
    cond = F.col("career_playoff_series") > min_series
    if min_minutes is not None:
        aggs.append(F.sum(minutes_col).alias("career_playoff_minutes"))
        cond = cond & (F.col("career_playoff_minutes") > min_minutes)
    return df.groupBy("person_id").agg(*aggs).where(cond)


def by_series(spans: DataFrame, per_person: DataFrame) -> DataFrame:
    """A per-person table brought to the (person, series) rows of ``spans``
    (persons without a row there are left out).  Rows are joined to it with
    ``join_series``: on the person alone a hot person's rows would all meet
    in one task, and a career has far fewer series than rows."""
    return spans.join(per_person, "person_id", "inner")


def join_series(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of their (person, series) row of ``table``;
    a NULL series is a series of its own, a NULL person has no row."""
    t = table.withColumnsRenamed({"person_id": "_js_p", "series_id": "_js_s"})
    return (rows.join(t, (F.col("person_id") == F.col("_js_p")) & F.col("series_id").eqNullSafe(F.col("_js_s")), "inner")
            .drop("_js_p", "_js_s"))


def eligible_series_rows(rows: DataFrame, min_series: int = 10) -> DataFrame:
    """W-01 + D-22 in one join: the rows of persons with more than
    ``min_series`` series, with the first game time of their (person, series).
    The series are one row each here, so D-22 counts them over the person,
    where they are dealt anyway, and they go from there to the rows."""
    spans = rows.groupBy("person_id", "series_id").agg(F.min("game_ts").alias("series_start_ts"))
    spans = spans.withColumn("_n", F.count("series_id").over(W.partitionBy("person_id")))
    return join_series(rows, spans.where(F.col("_n") > min_series).drop("_n"))


def join_player_elo(elo: DataFrame, players: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """J-08 + J-10: attach each eligible player's game row to the forecast
    game of the same date and team pair, in either orientation
    (``eligible=None``: the players are eligible ones already).

    The OR of two orientations becomes one equi-join on (date, min team,
    max team) — NULL-propagating, so a missing id never matches — and the
    player's side is derived afterwards.  The join is one shuffle on the
    game key; eligibility is a semi-join on a per-person table."""
    # the pair's order is part of the condition, so the rows carry no copies of their keys
    low, high = (lambda a, b, f=f: f(F.col(a).cast("bigint"), F.col(b).cast("bigint")) for f in (safe.least_nn, safe.greatest_nn))
    if eligible is not None:
        players = players.join(eligible.select("person_id"), "person_id", "left_semi")
    p = players.withColumnRenamed("game_id", "kaggle_game_id")
    ours, theirs = ("player_team_id", "opponent_team_id"), ("kaggle_team_id", "kaggle_opp_team_id")
    j = elo.join(p, (F.col("date_game") == F.col("game_date")) & (low(*theirs) == low(*ours))
                 & (high(*theirs) == high(*ours)), "inner")
    # the OR condition, exactly: same pair in one of the two orientations
    kt, ko = F.col("kaggle_team_id").cast("bigint"), F.col("kaggle_opp_team_id").cast("bigint")
    pt, po = F.col("player_team_id"), F.col("opponent_team_id")
    j = j.where(((kt == pt) & (ko == po)) | ((ko == pt) & (kt == po)))
    side = F.when(kt == pt, "elo_team").when(ko == pt, "elo_opponent")
    return j.withColumn("player_elo_side", side)


def game_residuals(joined: DataFrame) -> DataFrame:
    """D-16/D-17: the player's side forecast (p or 1−p), its price, the
    home-view result, the player's result and the rounded residual."""
    kt, ko = F.col("kaggle_team_id").cast("bigint"), F.col("kaggle_opp_team_id").cast("bigint")
    pt = F.col("player_team_id")
    p = F.col("forecast").try_cast("double")
    res = F.col("game_result")
    team_side, opp_side = kt == pt, ko == pt
    out = joined.withColumns({
        "player_game_forecast": F.when(team_side, p).when(opp_side, F.lit(1) - p),
        "player_game_money_line": side_american_price(F.col("forecast"), team_side, opp_side),
        "elo_team_win": F.when(res == "W", 1).when(res == "L", 0),
        "player_win": (F.when(team_side & (res == "W"), 1).when(team_side & (res == "L"), 0)
                       .when(opp_side & (res == "W"), 0).when(opp_side & (res == "L"), 1)),
    })
    return out.withColumn("game_residual",
                          F.round(F.col("player_win").cast("double") - F.col("player_game_forecast"), 4))


# -- running residuals at three grains -------------------------------------------------


def running_game(df: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-19 (game grain): career running sum of game residuals by game time
    and id, rounded to 4."""
    out = running_sum(df, ["person_id"], ["game_ts", "kaggle_game_id"], "game_residual",
                      "_run", frame="rows", piece_rows=piece_rows)
    return out.withColumn("career_game_running_residual", F.round("_run", 4)).drop("_run")


def player_series_residuals(games: DataFrame, series_res: DataFrame) -> DataFrame:
    """Distinct (person, series result) rows: a person's series with its
    result and residual.  The rows are dealt by series once: the distinct
    rows, the join and the distinct result all stay there."""
    keys = ["series_id", "player_team_id", "opponent_team_id", "year_id"]
    g = games.select("person_id", *keys[:3], F.col("year_id").try_cast("bigint").alias("year_id")) \
        .repartition(*keys).distinct()
    return g.join(series_res, keys, "inner") \
        .select("person_id", "year_id", "series_id", "player_team_id", "opponent_team_id", "series_start_ts",
                "team_series_games", "team_series_wins", "opponent_series_wins", "series_win",
                "series_forecast", "series_money_line", "series_residual").distinct()


def running_series(ps: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-19 (series grain): career running sum of series residuals by series
    start and id, rounded to 4."""
    out = running_sum(ps, ["person_id"], SERIES_ORDER, "series_residual",
                      "_run", frame="rows", piece_rows=piece_rows)
    return out.withColumn("career_series_running_residual", F.round("_run", 4)).drop("_run")


def running_year(games: DataFrame, ps: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-19 (year grain): per (person, year) the rounded sums of game and of
    series residuals (a year without series counts 0), and their career
    running sums — rounded sums accumulate, then round again."""
    yg = (games.groupBy("person_id", F.col("year_id").try_cast("bigint").alias("year_id"))
          .agg(F.round(F.sum("game_residual"), 4).alias("year_game_residual")))
    ys = (ps.groupBy("person_id", "year_id")
          .agg(F.round(F.sum("series_residual"), 4).alias("year_series_residual")))
    y = yg.join(ys, ["person_id", "year_id"], "left").withColumn(
        "year_series_residual", F.coalesce("year_series_residual", F.lit(0.0)))
    y = running_aggs(y, ["person_id"], ["year_id"],
                     {"_g": ("sum", "year_game_residual"), "_s": ("sum", "year_series_residual")},
                     "rows", piece_rows)
    return (y.withColumn("career_year_game_running_residual", F.round("_g", 4))
            .withColumn("career_year_series_running_residual", F.round("_s", 4))
            .drop("_g", "_s"))


def career_bounds(df: DataFrame, value: str, order: list[str], last_name: str, max_name: str) -> DataFrame:
    """D-20: per person, the last non-null running value in ``order`` and
    the maximum — both partial-aggregated, no per-career sort."""
    return df.groupBy("person_id").agg(last_non_null(value, *order).alias(last_name),
                                       F.max(value).alias(max_name))
