"""Curated wide tables and reports composed from the operators
(D-21, D-23, D-27, D-28, D-29)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.odds import american_price, logit
from ..sources.sinks import materialize
from . import residual as R
from . import series_ops as SO
from .odds_ops import side_odds
from .prefix import PIECE_ROWS, dense_rank_by, dense_rank_table, running_aggs, running_sum


class ResidualTables:
    """Intermediate relations of the flagship, for reuse by later reports.

    ``games`` (player-game rows with residuals) is built eagerly; the series
    and person-series relations are built on first use, so callers that
    only need the game rows never pay for them.
    """

    def __init__(self, games: DataFrame, mirror_venue: bool, enumerate_paths: bool, persist: bool):
        self.games = games
        self._mirror, self._enum, self._persist = mirror_venue, enumerate_paths, persist

    @cached_property
    def first_games(self) -> DataFrame:
        return SO.first_game_per_series(
            self.games, cols=["year_id", "series_start_ts", "player_home", "player_game_forecast", "game_label"])

    @cached_property
    def series_odds(self) -> DataFrame:
        return (SO.series_odds_enumerated(self.first_games) if self._enum
                else SO.series_odds(self.first_games, self._mirror))

    @cached_property
    def series_res(self) -> DataFrame:
        """per (series, side, opponent, year)"""
        return SO.series_residuals(SO.series_results(self.games), self.series_odds)

    @cached_property
    def player_series(self) -> DataFrame:
        """per (person, series result)"""
        ps = R.player_series_residuals(self.games, self.series_res)
        return materialize(ps, "player_series_base") if self._persist else ps


# What the series and running-residual relations read of a game row.
RESIDUAL_COLS = ["person_id", "series_id", "kaggle_game_id", "player_team_id", "opponent_team_id", "year_id", "game_ts",
                 "series_start_ts", "series_game_number", "game_label", "player_home", "player_game_forecast",
                 "player_win", "game_residual"]
ROW = "_row"
_JOIN_COLS = ["person_id", "game_id", "series_id", "game_ts", "player_team_id", "opponent_team_id"]


def residual_tables(stats: DataFrame, elo: DataFrame, min_series: int = 10,
                    mirror_venue: bool = False, enumerate_paths: bool = False,
                    persist: bool = True, columns: list[str] | None = None) -> ResidualTables:
    """Player-game residuals, series residuals and person-series rows.

    The player-game base feeds four branches (game running sums, series
    first games, series results, person-series rows).  With ``persist`` it
    is written once as a Parquet table in the shared checkpoint folder and
    read back: the branches scan it instead of recomputing the joins, and a
    lost executor restarts from the table, not from the sources.
    ``columns`` names the game columns that the caller reads besides
    ``RESIDUAL_COLS``; a write keeps what it is given, so others are dropped
    before it (None: all are kept); ``ROW`` among them numbers the rows (for
    a written table, where the numbers stand).
    """
    raw = R.raw_player_games(stats)
    base = R.dedup_player_game(raw)
    keep = None if columns is None else list(dict.fromkeys([*RESIDUAL_COLS, *columns]))
    if keep is not None:
        base = base.select(*[c for c in base.columns if c in {*keep, *_JOIN_COLS}])
    if persist:
        # read twice: the persons' series and the join to the forecast games
        base = materialize(base, "player_games_dedup")
    players = R.eligible_series_rows(base, min_series)
    if "game_date" not in players.columns:
        players = players.withColumn("game_date", F.to_date("game_ts"))      # as made of it, and not dealt with the rows
    joined = R.join_player_elo(elo, players)
    games = R.game_residuals(joined)
    if keep is not None:
        if ROW in keep:
            games = games.withColumn(ROW, F.monotonically_increasing_id())
        games = games.select(*keep)
    if persist:
        games = materialize(games, "player_game_base")
    return ResidualTables(games, mirror_venue, enumerate_paths, persist)


GAME_OUT = [
    "person_id", "first_name", "last_name", "game_id", "kaggle_game_id", "player_team_id",
    "opponent_team_id", "player_home", "player_elo_side", "kaggle_team_id", "kaggle_opp_team_id",
    "series_id", "series_game_number", "game_label", "year_id", "date_game", *R.STAT_COLS[:8],
    "field_goals_percentage", "turnovers",
]


def player_game_residuals(stats: DataFrame, elo: DataFrame, min_series: int = 10,
                          mirror_venue: bool = False, piece_rows: int = PIECE_ROWS,
                          columns: list[str] | None = None) -> DataFrame:
    """D-29: the flagship wide table — one row per eligible player game with
    game, series and year residual context and career bounds; ``columns``
    names those of its columns that the caller reads (None: all).

    Everything is computed on narrow rows (keys and residual) that carry the
    number of their game row; the wide row meets them once, on that number.
    Where only the series context is read, the wide row meets it on the
    series, and a rollup by series needs no further shuffle.
    """
    columns = columns or FLAGSHIP_COLUMNS
    context = [c for c in columns if c in _CONTEXT]
    # the spines with their running values are read twice (career bounds and
    # the output): write them once; where only the series context is read,
    # nothing reads a running value, and a write would hold it for nobody
    series = ["person_id", "series_id", "player_team_id", "opponent_team_id"]
    by_series = set(context) <= set(SERIES_CONTEXT) and set(series) <= set(columns)
    row = [] if by_series else [ROW]
    t = residual_tables(stats, elo, min_series, mirror_venue,
                        columns=[*row, *[FLAGSHIP_SOURCE.get(c, c) for c in columns if c not in _CONTEXT]])
    carried = [] if by_series else [ROW, *series[1:], F.col("year_id").try_cast("bigint").alias("_year_key")]
    g = R.running_game(t.games.select("person_id", "game_ts", "kaggle_game_id", "game_residual", *carried), piece_rows)
    s = R.running_series(t.player_series, piece_rows)
    if not by_series:
        g, s = materialize(g, "player_game_running"), materialize(s, "player_series_running")
    game_bounds = R.career_bounds(g, "career_game_running_residual", ["game_ts", "kaggle_game_id"],
                                  "career_game_last_cumulative_residual",
                                  "career_game_max_cumulative_residual")
    series_bounds = R.career_bounds(s, "career_series_running_residual", R.SERIES_ORDER,
                                    "career_series_last_cumulative_residual",
                                    "career_series_max_cumulative_residual")
    y = R.running_year(t.games, t.player_series, piece_rows)
    yb = y.groupBy("person_id").agg(
        R.last_non_null("career_year_game_running_residual", "year_id")
        .alias("career_year_game_last_cumulative_residual"),
        R.last_non_null("career_year_series_running_residual", "year_id")
        .alias("career_year_series_last_cumulative_residual"),
        F.max("career_year_game_running_residual").alias("career_year_game_max_cumulative_residual"),
        F.max("career_year_series_running_residual").alias("career_year_series_max_cumulative_residual"))

    wide = t.games.select(*row, *[
        (american_price("forecast") if c == "forecast_money_line" else F.col(FLAGSHIP_SOURCE.get(c, c))).alias(c)
        for c in columns if c not in _CONTEXT])
    sr = s.select(*series, *SERIES_CONTEXT)
    if by_series:
        return wide.join(sr, series, "left").select(*columns)
    # a person's bounds go to the person's years, which are few, and from there to the rows; a NULL year has
    # bounds but no year context
    yr = (y.withColumns({c: F.when(F.col("year_id").isNotNull(), F.col(c)) for c in YEAR_CONTEXT})
          .join(game_bounds, "person_id", "left").join(series_bounds, "person_id", "left").join(yb, "person_id", "left")
          .withColumnsRenamed({"person_id": "_yr_p", "year_id": "_yr_y"}))
    spine = g.select(ROW, *series, "_year_key", "career_game_running_residual").join(sr, series, "left")
    spine = spine.join(yr, (F.col("person_id") == F.col("_yr_p")) & F.col("_year_key").eqNullSafe(F.col("_yr_y")), "left")
    spine = spine.select(F.col(ROW).alias("_spine_row"), *context)
    return wide.join(spine, F.col(ROW) == F.col("_spine_row"), "inner").select(*columns)


FLAGSHIP_COLUMNS = [
    *GAME_OUT, "elo_team", "elo_team_abbrev", "elo_opponent_abbrev", "elo_opponent",
    "elo_team_win_lose", "elo_team_pts", "elo_opponent_pts", "elo_team_elo_i", "elo_team_elo_n",
    "elo_opponent_elo_i", "elo_opponent_elo_n", "win_equiv", "forecast", "forecast_money_line",
    "player_game_forecast", "player_game_money_line", "player_win", "game_residual",
    "career_game_last_cumulative_residual", "career_game_max_cumulative_residual",
    "career_game_running_residual", "team_series_wins", "opponent_series_wins", "series_forecast",
    "series_money_line", "series_win", "series_residual", "career_series_running_residual",
    "career_series_last_cumulative_residual", "career_series_max_cumulative_residual",
    "year_game_residual", "year_series_residual", "career_year_game_running_residual",
    "career_year_series_running_residual", "career_year_game_last_cumulative_residual",
    "career_year_series_last_cumulative_residual", "career_year_game_max_cumulative_residual",
    "career_year_series_max_cumulative_residual",
]

# Where a column of the flagship comes from, if not from the game column of its name.
FLAGSHIP_SOURCE = {
    "elo_team": "fran_id", "elo_team_abbrev": "team_id", "elo_opponent_abbrev": "opp_id", "elo_opponent": "opp_fran",
    "elo_team_win_lose": "game_result", "elo_team_pts": "pts", "elo_opponent_pts": "opp_pts",
    "elo_team_elo_i": "elo_i", "elo_team_elo_n": "elo_n", "elo_opponent_elo_i": "opp_elo_i",
    "elo_opponent_elo_n": "opp_elo_n", "forecast_money_line": "forecast",
}
SERIES_CONTEXT = ["team_series_wins", "opponent_series_wins", "series_forecast", "series_money_line", "series_win",
                  "series_residual", "career_series_running_residual"]
YEAR_CONTEXT = ["year_game_residual", "year_series_residual", "career_year_game_running_residual",
                "career_year_series_running_residual"]
_CONTEXT = {"career_game_running_residual", "career_game_last_cumulative_residual",
            "career_game_max_cumulative_residual", *FLAGSHIP_COLUMNS[FLAGSHIP_COLUMNS.index("team_series_wins"):]}

# What the player-series rollup reads of the flagship.
ROLLUP_COLUMNS = [
    "person_id", "first_name", "last_name", "kaggle_game_id", "player_team_id", "opponent_team_id", "series_id",
    "year_id", "date_game", *R.STAT_COLS, "player_game_forecast", "game_residual", "series_forecast",
    "series_money_line", "series_win", "series_residual",
]

# What the career timeline reads of the flagship, and of the rollup made of it.
TIMELINE_SOURCE = ["person_id", "first_name", "last_name", "player_team_id", "opponent_team_id", "series_id", "year_id",
                   "date_game", "num_minutes", "series_forecast", "series_win", "series_residual"]
TIMELINE_COLUMNS = ["series_start_date", "series_minutes", "actual_win", "expected_win_prob", "series_residual"]


SERIES_OUT = [
    "series_start_date", "series_end_date", "player_series_games_played", "series_minutes", "series_points",
    "series_assists", "series_rebounds_total", "series_blocks", "series_steals", "series_field_goals_attempted",
    "series_field_goals_made", "series_field_goals_percentage", "series_turnovers", "actual_win",
    "expected_win_prob", "expected_money_line", "series_residual", "series_sum_game_residual",
    "avg_player_game_forecast",
]


def player_series(flagship: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D-21: one row per (person, year, series, side, opponent) with valid
    series odds: box-score sums, field-goal ratio, outcome, expectation and
    residual sums; ``columns`` names those of these that the caller reads
    (None: all)."""
    f = flagship.where(F.col("person_id").isNotNull() & F.col("series_id").isNotNull()
                       & F.col("series_win").isNotNull() & F.col("series_forecast").isNotNull()
                       & (F.col("series_forecast") > 0) & (F.col("series_forecast") < 1))
    out = {
        "series_start_date": F.min("date_game"), "series_end_date": F.max("date_game"),
        "player_series_games_played": F.count_distinct("kaggle_game_id"), "series_minutes": F.sum("num_minutes"),
        **{f"series_{c}": F.sum(c) for c in R.STAT_COLS[1:]},
        "series_field_goals_percentage": safe.safe_divide(F.sum("field_goals_made"), F.sum("field_goals_attempted")),
        "actual_win": F.max("series_win"), "expected_win_prob": F.max("series_forecast"),
        "expected_money_line": F.max("series_money_line"), "series_residual": F.max("series_residual"),
        "series_sum_game_residual": F.sum("game_residual"), "avg_player_game_forecast": F.avg("player_game_forecast"),
    }
    names = SERIES_OUT if columns is None else [c for c in SERIES_OUT if c in columns]
    return (f.groupBy("person_id", F.col("year_id").try_cast("bigint").alias("year_id"), "series_id",
                      "player_team_id", "opponent_team_id")
            .agg(F.any_value("first_name", True).alias("first_name"),
                 F.any_value("last_name", True).alias("last_name"), *[out[c].alias(c) for c in names])
            .select("person_id", "first_name", "last_name", "year_id", "series_id", "player_team_id",
                    "opponent_team_id", *names))


def rate_features(ps: DataFrame, min_series: int = 10, min_minutes: float = 4000.0) -> DataFrame:
    """D-23 (+ D-22 with minutes): model input — valid rows, expected logit,
    career filters joined back, per-36 rates; of a rollup without some of the
    box-score sums, without their career totals and rates."""
    base = (ps.where(F.col("person_id").isNotNull() & F.col("series_id").isNotNull()
                     & F.col("player_team_id").isNotNull() & F.col("opponent_team_id").isNotNull()
                     & F.col("actual_win").isNotNull() & F.col("actual_win").isin(0, 1)
                     & F.col("expected_win_prob").isNotNull() & (F.col("expected_win_prob") > 0)
                     & (F.col("expected_win_prob") < 1) & F.col("series_minutes").isNotNull()
                     & (F.col("series_minutes") > 0))
            .withColumn("expected_logit", logit("expected_win_prob")))
    # career totals come from one narrow row a (person, series, side) and go back to these keys: the rollup's rows are
    # dealt by them already, so they stay where they are; only the keys of a person's series meet on the person
    keys = ["person_id", "series_id", "player_team_id", "opponent_team_id"]
    totals = [c for c in ("series_minutes", "series_points", "series_assists", "series_rebounds_total") if c in base.columns]
    sides = materialize(base.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals]), "rate_sides")
    career = (sides.groupBy("person_id")
              .agg(F.count_distinct("series_id").alias("career_playoff_series"),
                   *[F.sum(c).alias(c.replace("series", "career_playoff", 1)) for c in totals])
              .where((F.col("career_playoff_series") > min_series)
                     & (F.col("career_playoff_minutes") > min_minutes)))
    side_career = sides.select(*keys).join(career, "person_id", "inner").withColumnsRenamed({k: f"_rf_{k}" for k in keys})
    out = base.join(side_career, [F.col(k) == F.col(f"_rf_{k}") for k in keys], "inner").drop(*[f"_rf_{k}" for k in keys])
    per36 = {c: f"{c.removesuffix('_total')}_per_36" for c in
             ("series_points", "series_assists", "series_rebounds_total", "series_blocks", "series_steals", "series_turnovers")}
    return out.select("*", *[(safe.safe_divide(F.col(c), F.col("series_minutes")) * 36).alias(n)
                             for c, n in per36.items() if c in base.columns])


# -- market residual reports ---------------------------------------------------------------


def _market_base(stats: DataFrame, min_series: int, persist: bool):
    raw = stats.where(F.col("game_type") == "Playoffs")
    ts = F.col("game_date_time_est").cast("timestamp")
    p = raw.select("person_id", "first_name", "last_name", "game_id",
                   F.col("player_team_id").cast("bigint").alias("player_team_id"),
                   F.col("opponent_team_id").cast("bigint").alias("opponent_team_id"),
                   "game_label", "game_date_time_est", ts.alias("game_ts"),
                   R.series_key(ts, "game_label", "player_team_id", "opponent_team_id").alias("series_id"),
                   safe.extract_digits(F.col("series_game_number").cast("string")).alias("series_game_number"))
    if persist:
        # read twice: the persons' series and the rows themselves
        p = materialize(p, "market_base")
    return R.eligible_series_rows(p, min_series)


def market_rows(stats: DataFrame, team_stats: DataFrame, quotes: DataFrame, min_series: int = 10,
                drop_missing: bool = False, persist: bool = True) -> DataFrame:
    """Eligible players' playoff game rows with the team result, the
    market's implied probability for the player's side and the residual
    ``_r`` (win − probability).  Persisted once: every market report reads
    these rows several times (running total, series totals, series order,
    career max)."""
    p = _market_base(stats, min_series, persist)
    # inputs derived from the same tables: join on renamed keys only, never
    # on two references to one lineage's column
    t = team_stats.select(F.col("game_id").alias("_t_game"), F.col("team_id").alias("_t_team"), "win")
    o = side_odds(quotes, zero="one").select(F.col("game_id").alias("_o_game"),
                                             F.col("target_team_id").alias("_o_team"), "implied_win_prob")
    gk = F.col("game_id").cast("bigint")
    j = (p.join(t, (gk == F.col("_t_game")) & (F.col("player_team_id") == F.col("_t_team")), "inner")
         .drop("_t_game", "_t_team"))
    j = j.join(o, (gk == F.col("_o_game")) & (F.col("player_team_id") == F.col("_o_team")), "left") \
        .drop("_o_game", "_o_team")
    if drop_missing:
        j = j.where(F.col("implied_win_prob").isNotNull() & F.col("win").isNotNull())
    j = j.withColumn("_r", F.col("win").cast("double") - F.col("implied_win_prob"))
    return materialize(j, "market_rows") if persist else j


def market_residual_games(stats: DataFrame, team_stats: DataFrame, quotes: DataFrame,
                          min_series: int = 10, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-27: game-grain residual of each eligible player against the market
    (average side price → probability), with the career running total
    (peers included), series total/average, series order and career max."""
    j = market_rows(stats, team_stats, quotes, min_series)
    ranks = dense_rank_table(j, ["person_id"], "series_start_ts", "player_series_order", piece_rows).select(
        F.col("person_id").alias("_rk_p"), F.col("series_start_ts").alias("_rk_start"), "player_series_order")
    # a series of a person has one start, so totals and rank are one row and meet the game rows in one join; rows
    # without a series have a rank but no totals
    series_tot = (j.groupBy("person_id", "series_id")
                  .agg(F.sum("_r").alias("_ssum"), F.avg("_r").alias("_savg"), F.min("series_start_ts").alias("_start")))
    series_tot = series_tot.withColumns({c: F.when(F.col("series_id").isNotNull(), F.col(c)) for c in ("_ssum", "_savg")})
    series_tot = series_tot.join(ranks, (F.col("person_id") == F.col("_rk_p"))
                                 & F.col("_start").eqNullSafe(F.col("_rk_start")), "left").drop("_rk_p", "_rk_start", "_start")
    j = running_sum(j, ["person_id"], ["game_ts"], "_r", "_cum", frame="range", piece_rows=piece_rows)
    j = R.join_series(j, series_tot)
    j = j.select("person_id", "first_name", "last_name", "series_id", "series_game_number", "game_id",
                 "game_date_time_est", "win",
                 F.round("implied_win_prob", 4).alias("implied_win_prob"),
                 F.round("_r", 4).alias("game_residual"),
                 F.round("_cum", 4).alias("cumulative_career_game_residual"),
                 # ordered by a value constant within (person, series) under the
                 # default RANGE frame: the series total / average
                 F.round("_ssum", 4).alias("cumulative_series_residual"),
                 F.round("_savg", 4).alias("average_series_residual"),
                 "player_series_order")
    # read twice (career max and the output): write once
    j = materialize(j, "market_games_spine")
    spelled = j.groupBy("person_id", "series_id", "first_name", "last_name").agg(
        F.max("cumulative_career_game_residual").alias("_m"))
    mx = (spelled.groupBy("person_id", "first_name", "last_name")
          .agg(F.max("_m").alias("max_cumulative_career_game_residual"))
          .drop("first_name", "last_name"))
    out = R.join_series(j, R.by_series(spelled.select("person_id", "series_id").distinct(), mx))
    out = out.where(F.col("implied_win_prob").isNotNull() & F.col("game_residual").isNotNull()
                    & F.col("cumulative_career_game_residual").isNotNull()
                    & F.col("cumulative_series_residual").isNotNull())
    return out.orderBy(F.col("max_cumulative_career_game_residual").desc(),
                       F.col("player_series_order").desc(), F.col("series_game_number").desc())


def market_residual_series(stats: DataFrame, team_stats: DataFrame, quotes: DataFrame,
                           min_series: int = 10, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-28: series-grain market residuals: per-series sum and average of the
    game residuals (missing odds/results dropped first), the series order,
    and running sum / average over the player's series order (peers
    included), sorted by the career peak."""
    j = market_rows(stats, team_stats, quotes, min_series, drop_missing=True)
    g = j.select("person_id", "first_name", "last_name", "series_id", "series_start_ts",
                 F.col("_r").alias("game_residual"))
    ss = (g.groupBy("person_id", "first_name", "last_name", "series_id", "series_start_ts")
          .agg(F.sum("game_residual").alias("series_sum_residual"),
               F.avg("game_residual").alias("series_avg_residual")))
    ss = materialize(ss, "market_series")
    ss = dense_rank_by(ss, ["person_id"], "series_start_ts", "player_series_order", piece_rows)
    ss = running_aggs(ss, ["person_id"], ["player_series_order"],
                      {"cumulative_sum_series_residual": ("sum", "series_sum_residual"),
                       "_as": ("sum", "series_avg_residual"), "_ac": ("count", "series_avg_residual")},
                      frame="range", piece_rows=piece_rows)
    ss = ss.withColumn("cumulative_avg_series_residual",
                       safe.safe_divide(F.col("_as"), F.col("_ac").cast("double"))).drop("_as", "_ac")
    # read twice (career peak and the output): write once
    ss = materialize(ss, "market_series_running")
    spans = ss.groupBy("person_id", "series_id").agg(F.max("cumulative_sum_series_residual").alias("_peak"))
    mx = spans.groupBy("person_id").agg(F.max("_peak").alias("_peak"))
    out = R.join_series(ss, R.by_series(spans.select("person_id", "series_id"), mx))
    return (out.orderBy(F.col("_peak").desc(), F.col("player_series_order").desc())
            .select("first_name", "last_name", "series_id", "player_series_order",
                    F.round("series_sum_residual", 4).alias("series_sum_residual"),
                    F.round("series_avg_residual", 4).alias("series_avg_residual"),
                    F.round("cumulative_sum_series_residual", 4).alias("cumulative_sum_series_residual"),
                    F.round("cumulative_avg_series_residual", 4).alias("cumulative_avg_series_residual")))
