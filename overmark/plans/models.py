"""The warehouse's 48 models by name, built from raw tables with the
library's operators.

``Warehouse(catalog).model(name)`` plays the part of ``ref()``: it builds
the model's dependencies first (memoised, so a model used twice is the
same DataFrame) and returns a lazy DataFrame.  ``materialize=True`` writes
models configured as tables to the shared folder and reads them back, like
the warehouse's table materialisation; views stay lazy.

Raw tables are looked up in the catalog by their source name
(``nba_raw.games`` …), so registering those names (paths or session
tables) is all a user switching over has to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.odds import implied_prob
from ..operators import identity as I
from ..operators import odds_ops
from ..operators import reports as RP
from ..sources import conform as cf
from ..sources.catalog import Catalog
from ..sources.sinks import materialize as write_table
from ..sources.specs import DERIVED_MODELS, STAGING_SPECS

# Relocated-franchise abbreviation remaps and the franchise
# alias used before a rename season.
ABBREV_REMAP = {"CHH": "CHA", "WSB": "WAS"}
FRAN_ALIASES = {"PELICANS": ("HORNETS", 2014)}

# Models materialised as tables (the others are views).
TABLE_MODELS = {*STAGING_SPECS, *DERIVED_MODELS, "stg_nba_betting_games_all", "stg_nba_custom_betting_final",
                "nba_elo_post_1977", "nba_elo_pre_1976", "nba_elo_playoffs_post_1977",
                "nba_elo_playoffs_pre_1976"}


class Warehouse:
    def __init__(self, catalog: Catalog, materialize: bool = False):
        self.cat = catalog
        self.materialize = materialize
        self._built: dict[str, DataFrame] = {}

    def raw(self, source: str) -> DataFrame:
        return self.cat.scan(source)

    def model(self, name: str) -> DataFrame:
        if name not in self._built:
            df = BUILDERS[name](self)
            if self.materialize and name in TABLE_MODELS:
                df = write_table(df, name)
            self._built[name] = df
        return self._built[name]

    __getitem__ = model


def _staging(model: str) -> Callable[[Warehouse], DataFrame]:
    def build(w: Warehouse) -> DataFrame:
        base = DERIVED_MODELS[model][0] if model in DERIVED_MODELS else model
        return cf.conform_model(w.raw(STAGING_SPECS[base][0]), model)
    return build


# Curated models that are one projection of one model: a DataFrame selects these
# SQL expressions, and a persistent view is made of the same text.
# name → (parent, series id before this column, label, game number, renamed time, columns put after another)
CURATED = {
    "nba_kaggle_games": ("stg_nba_kaggle_games", "game_label", True, "fix", False,
                         {"game_sublabel": "series_game_number"}),
    "nba_kaggle_player_statistics": ("stg_nba_kaggle_player_statistics", "game_label", True, "fix", False, {}),
    "nba_kaggle_player_statistics_extended": ("stg_nba_kaggle_player_statistics_extended", "game_type", True, "fix",
                                              True, {}),
    "nba_kaggle_team_statistics": ("stg_nba_kaggle_team_statistics", None, True, "cast", True, {}),
    "nba_kaggle_team_statistics_extended": ("stg_nba_kaggle_team_statistics_extended", None, True, "fix", True, {}),
    "nba_kaggle_play_by_play": ("stg_nba_kaggle_play_by_play", None, False, None, True, {}),
}
SAME = {**{m: f"stg_{m}" for m in (
    "nba_elo_post_1977", "nba_elo_pre_1976", "nba_elo_playoffs_post_1977", "nba_elo_playoffs_pre_1976",
    "nba_betting_games_all", "nba_betting_money_line", "nba_betting_totals", "nba_betting_teams_all",
    "nba_betting_players_all", "nba_betting_players_game_stats", "nba_kaggle_players", "nba_kaggle_team_histories")},
    "nba_betting_final": "stg_nba_custom_betting_final"}

SERIES_ID = ("regexp_replace(lower(concat(cast(year(to_date(game_date_time_est)) as string), game_label)), "
             "'[^a-z0-9]', '') as series_id")
NUMBER = {"fix": "cast(case when series_game_number like '%1%' then '1' else series_game_number end as double)",
          "cast": "cast(series_game_number as double)"}


def parent_of(name: str) -> str | None:
    """The model that ``name`` is one projection of; None for other models."""
    return CURATED[name][0] if name in CURATED else SAME.get(name)


def projection(name: str, columns: list[str]) -> list[str]:
    """SQL expressions over the ``columns`` of the model's parent."""
    if name in SAME:
        return [f"`{c}`" for c in columns]
    _, series, label, number, rename, moved = CURATED[name]
    order = [c for c in columns if c not in moved]
    for c, after in moved.items():
        order.insert(order.index(after) + 1, c)
    out = []
    for c in order:
        if c == series:
            out.append(SERIES_ID)
        if c == "game_label" and label:
            out.append("replace(game_label, '- ', '') as game_label")
        elif c == "series_game_number" and number:
            out.append(f"{NUMBER[number]} as series_game_number")
        elif c == "game_date_time_est" and rename:
            out.append("game_date_time_est as game_datetime_est")
        else:
            out.append(f"`{c}`")
    return out


def _projected(name: str) -> Callable[[Warehouse], DataFrame]:
    def build(w: Warehouse) -> DataFrame:
        parent = w.model(parent_of(name))
        return parent.selectExpr(*projection(name, parent.columns))
    return build


def _player_statistics(w: Warehouse) -> DataFrame:
    """STG-20: conform, then back-fill missing team ids by city + name."""
    st = cf.conform_model(w.raw("nba_raw.player_statistics"), "stg_nba_kaggle_player_statistics")
    hist = w.model("stg_nba_kaggle_team_histories")
    out = I.backfill_team_id(st, hist)
    order = [c for c in st.columns if c not in ("player_team_id_raw", "opponent_team_id_raw")]
    i = order.index("plus_minus_points") + 1
    return out.select(*order[:i], "player_team_id", "opponent_team_id", *order[i:])


def _games_all(w: Warehouse) -> DataFrame:
    """STG-8: one row per game from the home and away rows."""
    raw = w.raw("nba_odds_raw.nba_games_all")
    typed = raw.select(
        safe.safe_cast("game_id", "bigint").alias("game_id"), safe.safe_cast("game_date", "date").alias("game_date"),
        F.col("matchup").cast("string").alias("matchup"), safe.safe_cast("team_id", "bigint").alias("team_id"),
        safe.safe_cast("pts", "bigint").alias("pts"), F.col("wl").cast("string").alias("wl"),
        safe.safe_cast("season_year", "bigint").alias("season_year"),
        F.col("season_type").cast("string").alias("season_type"), F.col("season").cast("string").alias("season"),
        safe.safe_bool("is_home").alias("is_home"))
    return odds_ops.home_away_pivot(
        typed,
        home_cols={"game_date": "game_date", "matchup": "matchup", "team_id": "home_team_id", "pts": "home_pts",
                   "wl": "home_wl", "season_year": "season_year", "season_type": "season_type", "season": "season"},
        away_cols={"team_id": "away_team_id", "pts": "away_pts", "wl": "away_wl"}
    ).select("game_id", "game_date", "matchup", "home_team_id", "away_team_id", "season_year", "season_type",
             "season", "home_pts", "away_pts", "home_wl", "away_wl")


def _histories_nba_aba(w: Warehouse) -> DataFrame:
    h = w.raw("nba_raw.team_histories")
    return (h.where(F.col("league").isin("NBA", "ABA") & ~F.col("teamName").like("%All-Star%")
                    & ~F.col("teamName").like("%Team%"))
            .select(safe.safe_cast("teamId", "bigint").alias("team_id"),
                    F.trim(F.col("teamCity").cast("string")).alias("team_city"),
                    F.trim(F.col("teamName").cast("string")).alias("team_name"),
                    F.trim(F.col("teamAbbrev").cast("string")).alias("team_abbrev"),
                    safe.safe_cast("seasonFounded", "bigint").alias("season_founded"),
                    safe.safe_cast("seasonActiveTill", "bigint").alias("season_active_till")))


ELO_TEAM_SPEC = ("team_abbrev>team_abbrev:s! full_team_name>full_team_name:s! franch>franch:s! year:i "
                 "gms>games:i wins:i losses:i pf>points_for:i pa>points_against:i "
                 "ppg_diff>points_per_game_diff:f offense>offense_rating:f defense>defense_rating:f "
                 "elo_preseason:f elo_midseason:f end_of_rs>elo_end_of_regular_season:f playoffs_won:i "
                 "playoffs_lost:i outcome>playoff_outcome:s! po_elo>playoff_elo:f coaches:s!")


def _elo_teams(w: Warehouse) -> DataFrame:
    """STG-7: team seasons from 1977 with parsed city / nickname and the
    season-lagged team id (D-14, D-15)."""
    t = cf.conform(w.raw("nba_elo.nba_elo_teams_all_time"), ELO_TEAM_SPEC).where(F.col("year") >= 1977)
    out = I.match_team_season(t, _histories_nba_aba(w))
    first = ["team_id", "team_abbrev", "full_team_name", "team_city", "team_name", "franch", "year"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def _custom_betting_final(w: Warehouse) -> DataFrame:
    """STG-16: consensus money line per playoff game (D-06)."""
    return odds_ops.consensus_line(w.model("stg_nba_betting_money_line"), w.model("stg_nba_betting_games_all"))


def _series_odds(w: Warehouse) -> DataFrame:
    """CUR-11: implied probabilities of series prices (0 → NULL), rounded 4."""
    s = w.model("stg_nba_betting_series_odds")
    return s.select("*", F.round(implied_prob("home_odds", "null"), 4).alias("home_implied_probability"),
                    F.round(implied_prob("away_odds", "null"), 4).alias("away_implied_probability"))


def _elo_playoffs(w: Warehouse) -> DataFrame:
    e = w.model("stg_nba_elo_playoffs_post_1977").where(F.col("is_copy") == 0)
    return e.withColumns({"team_id": safe.remap_values("team_id", ABBREV_REMAP),
                          "opp_id": safe.remap_values("opp_id", ABBREV_REMAP)}).drop("is_copy")


def _elo_teams_mapping(w: Warehouse) -> DataFrame:
    """CUR-21: D-12 over the post-1977 playoff forecasts."""
    e = _elo_playoffs(w).drop("notes")
    codes = ["team_id", "opp_id"]
    e = e.select(*[c for c in e.columns if c not in codes], *codes)
    return I.resolve_team_validity(e, w.model("stg_nba_kaggle_team_histories"), fran_aliases=FRAN_ALIASES)


def _elo_games_all_time(w: Warehouse) -> DataFrame:
    """CUR-22: all-time playoff games in the forecast shape with ids by
    season team table, else manual override rows (D-11)."""
    a = w.model("stg_nba_all_time_playoffs").where(
        F.col("home_pts").isNotNull() & F.col("away_pts").isNotNull() & F.col("p_home_used").isNotNull())
    remap = lambda c: safe.remap_values(c, ABBREV_REMAP)
    g = a.select(
        F.col("game_id").cast("string").alias("game_id"), F.lit(0).alias("is_copy"),
        F.col("season").alias("year_id"), F.col("date_game"), F.lit(1).alias("is_playoffs"),
        F.col("team_id").alias("elo_team_abbrev_raw"), F.col("opp_id").alias("elo_opp_abbrev_raw"),
        remap("team_id").alias("team_id"), remap("opp_id").alias("opp_id"),
        remap("team_id").alias("fran_id"), remap("opp_id").alias("opp_fran"),
        F.col("home_pts").alias("pts"), F.col("away_pts").alias("opp_pts"),
        F.col("elo_home_po_pre").alias("elo_i"), F.col("elo_home_po_post").alias("elo_n"),
        F.col("elo_away_po_pre").alias("opp_elo_i"), F.col("elo_away_po_post").alias("opp_elo_n"),
        F.lit(None).cast("double").alias("win_equiv"), F.lit("H").alias("game_location"),
        F.when(F.col("home_win") == 1, "W").when(F.col("home_win") == 0, "L").alias("game_result"),
        F.col("p_home_used").alias("forecast"), F.lit(None).cast("string").alias("notes"))
    teams = w.model("stg_nba_elo_teams").select(
        F.col("team_id").alias("kaggle_team_id"), F.upper(F.trim("team_abbrev")).alias("team_abbrev"),
        F.col("year").alias("year_id"))
    out = I.resolve_team_override(g, teams, I.manual_overrides(g.sparkSession))
    return out.drop("elo_team_abbrev_raw", "elo_opp_abbrev_raw")


def _elo_with_ids(w: Warehouse) -> DataFrame:
    """The flagship's forecast games: ids by game id, else by date and the
    two (trimmed, upper-cased) abbreviations (J-07)."""
    e = _elo_playoffs(w)
    ids = w.model("elo_games_all_time").select(
        F.col("game_id").cast("string").alias("_gid"), "date_game", F.upper(F.trim("team_id")).alias("_t"),
        F.upper(F.trim("opp_id")).alias("_o"), "kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id")
    m1 = ids.select(F.col("_gid").alias("_g1"), *[F.col(c).alias(f"{c}_1") for c in
                                                  ("kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id")])
    m2 = ids.select(F.col("date_game").alias("_d2"), F.col("_t").alias("_t2"), F.col("_o").alias("_o2"),
                    *[F.col(c).alias(f"{c}_2") for c in
                      ("kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id")])
    j = e.join(m1, F.col("game_id") == F.col("_g1"), "left")
    j = j.join(m2, F.col("_g1").isNull() & (F.col("date_game") == F.col("_d2"))
               & (F.upper(F.trim("team_id")) == F.col("_t2")) & (F.upper(F.trim("opp_id")) == F.col("_o2")), "left")
    for c in ("kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id"):
        j = j.withColumn(c, F.coalesce(f"{c}_1", f"{c}_2"))
    return j.drop("_g1", "_d2", "_t2", "_o2", *[f"{c}_{i}" for c in
                                                 ("kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id")
                                                 for i in (1, 2)])


def _player_lines(w: Warehouse) -> DataFrame:
    return w.model("stg_nba_kaggle_player_statistics").withColumnRenamed("home", "player_home")


def _elo_games_mapping(w: Warehouse) -> DataFrame:
    """CUR-23: the flagship wide table (D-29)."""
    return RP.player_game_residuals(_player_lines(w), _elo_with_ids(w))


def _elo_series_mapping(w: Warehouse) -> DataFrame:
    """CUR-24: the player-series rollup (D-21)."""
    return RP.player_series(w.model("elo_games_mapping"))


BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {
    **{m: _staging(m) for m in STAGING_SPECS},
    **{m: _staging(m) for m in DERIVED_MODELS},
    "stg_nba_kaggle_player_statistics": _player_statistics,
    "stg_nba_betting_games_all": _games_all,
    "stg_nba_elo_teams": _elo_teams,
    "stg_nba_custom_betting_final": _custom_betting_final,
    # curated: projections of their staging models
    **{m: _projected(m) for m in (*SAME, *CURATED)},
    "nba_betting_series_odds": _series_odds,
    "elo_teams_mapping": _elo_teams_mapping,
    "elo_games_all_time": _elo_games_all_time,
    "elo_games_mapping": _elo_games_mapping,
    "elo_series_mapping": _elo_series_mapping,
}
