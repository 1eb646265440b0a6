"""Join, lateral, aggregate and set queries (J-*, A-*, O-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safe
from ..functions import series as S
from ..operators import common as C
from ..operators import identity as I
from ..operators import odds_ops
from ..operators import reports as RP
from ..operators import residual as R
from ..operators import series_ops as SO
from ..operators.intervals import cascade, interval_join
from . import oracle_bindings as ob
from .bindings import Bindings
from .q_reports import flag_sql
from .registry import query

# -- joins ------------------------------------------------------------------------------


@query("join_inner_multi_key", sql=ob.with_("player_line", "team_stat") + """
select p.person_id, p.game_id, p.player_team_id, t.win
from player_line p join team_stat t on p.game_id = t.game_id and p.player_team_id = t.team_id""")
def q_join_inner_multi_key(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    p = b.player_line.select("person_id", "game_id", "player_team_id")
    t = b.team_stat.withColumnRenamed("team_id", "player_team_id")
    return p.join(t, ["game_id", "player_team_id"], "inner").select("person_id", "game_id", "player_team_id", "win")


@query("join_home_away_pivot", sql=ob.with_("games_all", extra=[
    ("h", "select * from games_all where is_home = true"),
    ("a", "select * from games_all where is_home = false")]) + """
select h.game_id, h.game_date, h.team_id as home_team_id, a.team_id as away_team_id,
  h.pts as home_pts, a.pts as away_pts, h.wl as home_wl, a.wl as away_wl, h.season_type
from h join a on h.game_id = a.game_id""")
def q_join_home_away_pivot(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return odds_ops.home_away_pivot(
        b.games_all,
        home_cols={"game_date": "game_date", "team_id": "home_team_id", "pts": "home_pts", "wl": "home_wl",
                   "season_type": "season_type"},
        away_cols={"team_id": "away_team_id", "pts": "away_pts", "wl": "away_wl"})


@query("join_concat_key", sql=ob.with_("game_code", extra=[("t", """
  select distinct fran as full_team_name, season as year, upper(trim(team_code)) as team_abbrev from game_code""")]) + """
select a.full_team_name, a.year, a.team_abbrev, string_split(b.full_team_name, ' ')[1] as team_city
from t a join t b
  on a.full_team_name || '_' || cast(a.year as varchar) || '_' || a.team_abbrev
   = b.full_team_name || '_' || cast(b.year as varchar) || '_' || b.team_abbrev""")
def q_join_concat_key(spark, sf_dir):
    """Self-join on a composed string key (name_year_abbrev)."""
    c = Bindings(spark, sf_dir).game_code
    t = c.select(F.col("fran").alias("full_team_name"), F.col("season").alias("year"),
                 F.upper(F.trim("team_code")).alias("team_abbrev")).distinct()
    key = lambda d: F.concat(d["full_team_name"], F.lit("_"), d["year"].cast("string"), F.lit("_"),
                             d["team_abbrev"])
    parsed = t.select(key(t).alias("_k"), F.split("full_team_name", " ", -1).getItem(0).alias("team_city"))
    return t.join(parsed, key(t) == parsed["_k"], "inner").select("full_team_name", "year", "team_abbrev",
                                                                  "team_city")


@query("join_left_multi", sql=ob.with_("game_sides", "quote", extra=[("o", """
  select game_id, team_id as target_team_id, avg(price1) as avg_price from quote group by 1, 2
  union all
  select game_id, a_team_id, avg(price2) from quote group by 1, 2""")]) + """
select s.game_id, s.team_id, s.is_home, o.avg_price
from game_sides s left join o on s.game_id = o.game_id and s.team_id = o.target_team_id""")
def q_join_left_multi(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    o = odds_ops.side_odds(b.quote).select("game_id", F.col("target_team_id").alias("team_id"), "avg_price")
    return b.game_sides.select("game_id", "team_id", "is_home").join(o, ["game_id", "team_id"], "left")


@query("join_validity_interval", sql=ob.with_("game_code", "team_hist") + """
select g.game_id, g.team_code, g.season, h.team_id as kaggle_team_id
from game_code g left join team_hist h
  on upper(trim(g.team_code)) = upper(trim(h.team_abbrev))
 and g.season between h.season_founded and coalesce(h.season_active_till, 2100)""")
def q_join_validity_interval(spark, sf_dir):
    """Code equality plus year inside [founded, till]; an open end counts as
    2100."""
    b = Bindings(spark, sf_dir)
    h = b.team_hist.select(
        F.col("team_id").alias("kaggle_team_id"), F.upper(F.trim("team_abbrev")).alias("_abbr"),
        "season_founded", F.coalesce("season_active_till", F.lit(2100)).alias("_till"))
    out = interval_join(b.game_code, h, [(F.upper(F.trim("team_code")), "_abbr")], F.col("season"),
                        "season_founded", "_till")
    return out.select("game_id", "team_code", "season", "kaggle_team_id")


def _stats_with_raw_ids(b: Bindings):
    """Team-statistics rows with a NULL raw id on the 'ZZZ' codes, city and
    name to fall back on."""
    c = b.game_code
    k = F.regexp_extract("fran", r"(\d+)$", 1)
    return c.select("game_id", F.col("game_date").cast("timestamp").alias("game_date_time_est"),
                    F.when(F.col("team_code") == "ZZZ", F.lit(None).cast("bigint"))
                    .otherwise((F.lit(1000) + k.cast("bigint"))).alias("player_team_id_raw"),
                    F.lit("Club").alias("player_team_city"), k.alias("player_team_name"),
                    F.when(F.col("game_id") % 3 == 0, F.lit(None).cast("bigint"))
                    .otherwise(F.lit(1000) + F.col("game_id") % 4).alias("opponent_team_id_raw"),
                    F.lit("club ").alias("opponent_team_city"), (F.col("game_id") % 4).cast("string")
                    .alias("opponent_team_name"))


def _hist_city_name(b: Bindings):
    h = b.team_hist
    return h.select("team_id", F.lit("CLUB").alias("team_city"),
                    F.split("team_name", " ").getItem(1).alias("team_name"), "team_abbrev",
                    "season_founded", "season_active_till")


STATS_RAW_SQL = """
  select game_id, cast(game_date as timestamp) as game_date_time_est,
    case when team_code = 'ZZZ' then null else 1000 + cast(regexp_extract(fran, '([0-9]+)$', 1) as bigint) end
      as player_team_id_raw,
    'Club' as player_team_city, regexp_extract(fran, '([0-9]+)$', 1) as player_team_name,
    case when game_id % 3 = 0 then null else 1000 + game_id % 4 end as opponent_team_id_raw,
    'club ' as opponent_team_city, cast(game_id % 4 as varchar) as opponent_team_name
  from game_code"""
HIST_CN_SQL = """
  select team_id, 'CLUB' as team_city, string_split(team_name, ' ')[2] as team_name, team_abbrev,
    season_founded, season_active_till from team_hist"""


@query("join_conditional_fallback", sql=ob.with_("game_code", "team_hist", extra=[
    ("s", STATS_RAW_SQL), ("h", HIST_CN_SQL)]) + """
select s.game_id, coalesce(s.player_team_id_raw, h.team_id) as player_team_id
from s left join h
  on s.player_team_id_raw is null
 and lower(trim(s.player_team_city)) = lower(trim(h.team_city))
 and lower(trim(s.player_team_name)) = lower(trim(h.team_name))
 and year(s.game_date_time_est) between h.season_founded and h.season_active_till""")
def q_join_conditional_fallback(spark, sf_dir):
    """Left join whose ON clause also tests the left row (raw id NULL): rows
    with an id never match and are never dropped."""
    b = Bindings(spark, sf_dir)
    out = I.backfill_team_id(_stats_with_raw_ids(b), _hist_city_name(b),
                             sides=(("player_team_id_raw", "player_team_city", "player_team_name",
                                     "player_team_id"),))
    return out.select("game_id", "player_team_id")


@query("backfill_team_id", sql=ob.with_("game_code", "team_hist", extra=[
    ("s", STATS_RAW_SQL), ("h", HIST_CN_SQL)]) + """
select s.game_id, coalesce(s.player_team_id_raw, ph.team_id) as player_team_id,
  coalesce(s.opponent_team_id_raw, oh.team_id) as opponent_team_id
from s
left join h ph
  on s.player_team_id_raw is null
 and lower(trim(s.player_team_city)) = lower(trim(ph.team_city))
 and lower(trim(s.player_team_name)) = lower(trim(ph.team_name))
 and year(s.game_date_time_est) between ph.season_founded and ph.season_active_till
left join h oh
  on s.opponent_team_id_raw is null
 and lower(trim(s.opponent_team_city)) = lower(trim(oh.team_city))
 and lower(trim(s.opponent_team_name)) = lower(trim(oh.team_name))
 and year(s.game_date_time_est) between oh.season_founded and oh.season_active_till""")
def q_backfill_team_id(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    out = I.backfill_team_id(_stats_with_raw_ids(b), _hist_city_name(b))
    return out.select("game_id", "player_team_id", "opponent_team_id")


@query("join_cascade_coalesce", sql=ob.with_("game_code", "team_hist", extra=[("ids", """
  select g.game_id, g.game_date, upper(trim(g.team_code)) as team_key, h.team_id as kaggle_team_id
  from game_code g join team_hist h
    on upper(trim(g.team_code)) = h.team_abbrev
   and g.season between h.season_founded and coalesce(h.season_active_till, 2100)
  where g.game_id % 2 = 0""")]) + """
select g.game_id, coalesce(m1.kaggle_team_id, m2.kaggle_team_id) as kaggle_team_id
from game_code g
left join ids m1 on g.game_id = m1.game_id
left join (select game_date, team_key, min(kaggle_team_id) as kaggle_team_id from ids group by all) m2
  on m1.game_id is null and g.game_date = m2.game_date and upper(trim(g.team_code)) = m2.team_key""")
def q_join_cascade_coalesce(spark, sf_dir):
    """Second lookup only where the first missed: match by game id, else by
    (date, team), the smallest id of that day; a game stays one row."""
    b = Bindings(spark, sf_dir)
    g = b.game_code
    key = F.upper(F.trim("team_code"))
    h = b.team_hist.withColumn("_till", F.coalesce("season_active_till", F.lit(2100))).select(
        "team_abbrev", "season_founded", "_till", F.col("team_id").alias("kaggle_team_id"))
    ids = interval_join(g.where(F.col("game_id") % 2 == 0), h, [(key, "team_abbrev")], F.col("season"),
                        "season_founded", "_till", how="inner").withColumn("team_key", key)
    out = cascade(g.select("game_id", "game_date", "team_code"), [
        ([(F.col("game_id"), "game_id")], ids, "kaggle_team_id"),
        ([(F.col("game_date"), "game_date"), (key, "team_key")], ids, "kaggle_team_id")], "kaggle_team_id")
    return out.select("game_id", "kaggle_team_id")


@query("join_either_orientation", sql=flag_sql("base_player_games", """
select p.person_id, p.game_id as kaggle_game_id, e.game_id,
  case when e.kaggle_team_id = p.player_team_id then 'elo_team'
       when e.kaggle_opp_team_id = p.player_team_id then 'elo_opponent' end as player_elo_side
from elo_games e join base_player_games p
  on e.date_game = p.game_date
 and ((e.kaggle_team_id = p.player_team_id and e.kaggle_opp_team_id = p.opponent_team_id)
   or (e.kaggle_opp_team_id = p.player_team_id and e.kaggle_team_id = p.opponent_team_id))"""))
def q_join_either_orientation(spark, sf_dir):
    """Date equality AND (pair = (t, o) OR pair = (o, t)) as one equi-join on
    (date, min team, max team) plus the exact residual."""
    b = Bindings(spark, sf_dir)
    base = R.dedup_player_game(R.raw_player_games(b.player_line))
    everyone = base.select("person_id").distinct()
    j = R.join_player_elo(b.elo_games, base, everyone)
    return j.select("person_id", "kaggle_game_id", "game_id", "player_elo_side")


@query("join_semi_eligible", sql=flag_sql("player_playoff_games", """
select p.person_id, p.game_id, p.series_id from player_playoff_games p
where p.person_id in (select person_id from player_playoff_games group by person_id
                      having count(distinct series_id) > 167)"""))
def q_join_semi_eligible(spark, sf_dir):
    """Semi-join to the per-person eligible set (right side unique per
    person, so no fan-out)."""
    base = R.with_series_start(R.dedup_player_game(R.raw_player_games(Bindings(spark, sf_dir).player_line)))
    el = R.eligible_persons(base, 167).select("person_id")
    return base.join(el, "person_id", "left_semi").select("person_id", "game_id", "series_id")


@query("join_self_aggregate", sql=ob.with_("player_line", extra=[("m", """
  select person_id, max(points) as max_points from player_line group by person_id""")]) + """
select p.person_id, p.game_id, p.points, m.max_points
from player_line p join m on p.person_id = m.person_id""")
def q_join_self_aggregate(spark, sf_dir):
    """Rows joined to an aggregate of their own group: the per-person
    aggregate is partial-aggregated, then broadcast back (no per-person
    window sort)."""
    p = Bindings(spark, sf_dir).player_line
    m = p.groupBy("person_id").agg(F.max("points").alias("max_points"))
    return p.select("person_id", "game_id", "points").join(m, "person_id", "inner")


# -- laterals ---------------------------------------------------------------------------

FIRST_COLS = ["year_id", "series_start_ts", "player_home", "player_game_forecast", "game_label"]


def _first_games(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    t = RP.residual_tables(b.player_line, b.elo_games, columns=[])
    return SO.with_series_format(SO.first_game_per_series(t.games, cols=FIRST_COLS))


@query("lateral_posexplode", sql=flag_sql("sgp", """
select series_id, player_team_id, opponent_team_id, game_number, q as scheduled_player_game_forecast from sgp"""))
def q_lateral_posexplode(spark, sf_dir):
    """Unnest the venue schedule with its offset."""
    f = _first_games(spark, sf_dir)
    probs = S.scheduled_probs("home_schedule", "player_game_forecast", "player_home")
    return (f.select("series_id", "player_team_id", "opponent_team_id", F.posexplode(probs).alias("pos", "q"))
            .select("series_id", "player_team_id", "opponent_team_id",
                    (F.col("pos") + 1).cast("bigint").alias("game_number"),
                    F.col("q").alias("scheduled_player_game_forecast")))


@query("lateral_sequence", sql=flag_sql("series_format", """
select series_id, player_team_id, opponent_team_id, cast(p.path_number as bigint) as path_number
from series_format, range(0, 128) p(path_number)
where p.path_number < cast(pow(2, len(home_schedule)) as bigint)"""))
def q_lateral_sequence(spark, sf_dir):
    """Generated series 0 … 2^n − 1 per row (a bounded lateral: n ≤ 7)."""
    f = _first_games(spark, sf_dir)
    n = F.size("home_schedule")
    return f.select("series_id", "player_team_id", "opponent_team_id",
                    F.explode(F.sequence(F.lit(0).cast("bigint"),
                                         (F.pow(2, n).cast("bigint") - 1))).alias("path_number"))


# -- aggregates ---------------------------------------------------------------------------


@query("agg_basic", sql=ob.with_("player_line") + """
select person_id, player_team_id, cast(year(game_ts) as int) as game_year,
  cast(sum(points) as bigint) as points, avg(points) as avg_points, min(num_minutes) as min_minutes,
  max(num_minutes) as max_minutes, sum(num_minutes) as minutes
from player_line group by 1, 2, 3""")
def q_agg_basic(spark, sf_dir):
    """Group by columns and an expression; map-side partial aggregation."""
    p = Bindings(spark, sf_dir).player_line
    return (p.groupBy("person_id", "player_team_id", F.year("game_ts").alias("game_year"))
            .agg(F.sum("points").alias("points"), F.avg("points").alias("avg_points"),
                 F.min("num_minutes").alias("min_minutes"), F.max("num_minutes").alias("max_minutes"),
                 F.sum("num_minutes").alias("minutes")))


@query("agg_count_distinct", sql=flag_sql("raw_player_games", """
select person_id, count(distinct game_id) as games, count(distinct series_id) as series
from raw_player_games group by person_id"""))
def q_agg_count_distinct(spark, sf_dir):
    raw = R.raw_player_games(Bindings(spark, sf_dir).player_line)
    return raw.groupBy("person_id").agg(F.count_distinct("game_id").alias("games"),
                                        F.count_distinct("series_id").alias("series"))


@query("agg_having", sql=ob.with_("player_line") + """
select person_id, count(*) as n_lines, avg(points) as avg_points from player_line
group by person_id having avg(points) > 25.5""")
def q_agg_having(spark, sf_dir):
    p = Bindings(spark, sf_dir).player_line
    return (p.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_lines"), F.avg("points").alias("avg_points"))
            .where(F.col("avg_points") > 25.5))


@query("agg_any_value", sql=ob.with_("player_line") + """
select game_id, any_value(game_label) as game_label, any_value(year_id) as year_id, count(*) as n_lines
from player_line group by game_id""")
def q_agg_any_value(spark, sf_dir):
    """any_value ignoring NULLs, on attributes constant within the group."""
    p = Bindings(spark, sf_dir).player_line
    return p.groupBy("game_id").agg(F.any_value("game_label", True).alias("game_label"),
                                    F.any_value("year_id", True).alias("year_id"),
                                    F.count(F.lit(1)).alias("n_lines"))


@query("agg_conditional", sql=flag_sql("raw_player_games", """
select r.series_id, r.player_team_id, r.opponent_team_id,
  cast(sum(case when p.win = 1 then r.points else 0 end) as bigint) as points_in_wins,
  min(case when r.points >= 45 then r.series_game_number end) as first_big_game
from raw_player_games r join (select distinct game_id, person_id, win from player_line) p
  on r.game_id = p.game_id and r.person_id = p.person_id
group by 1, 2, 3"""))
def q_agg_conditional(spark, sf_dir):
    """sum(CASE … ELSE 0) and min(CASE … ) without ELSE (first qualifying)."""
    b = Bindings(spark, sf_dir)
    raw = R.raw_player_games(b.player_line)
    w = b.player_line.select("game_id", "person_id", "win").distinct()
    j = raw.join(w, ["game_id", "person_id"])
    return (j.groupBy("series_id", "player_team_id", "opponent_team_id")
            .agg(F.sum(F.when(F.col("win") == 1, F.col("points")).otherwise(F.lit(0))).alias("points_in_wins"),
                 F.min(F.when(F.col("points") >= 45, F.col("series_game_number"))).alias("first_big_game")))


@query("agg_ratio", sql=ob.with_("player_line") + """
select person_id, cast(sum(field_goals_made) as double) / nullif(sum(field_goals_attempted), 0) as fg_pct,
  cast(sum(points) as double) / nullif(sum(case when turnovers = 0 then 0 else 0 end), 0) as never_defined
from player_line group by person_id""")
def q_agg_ratio(spark, sf_dir):
    """Ratio of sums with a safe divide (NULL on a zero denominator)."""
    p = Bindings(spark, sf_dir).player_line
    return p.groupBy("person_id").agg(
        safe.safe_divide(F.sum("field_goals_made"), F.sum("field_goals_attempted")).alias("fg_pct"),
        safe.safe_divide(F.sum("points"), F.sum(F.lit(0))).alias("never_defined"))


@query("agg_last_by_order", sql=flag_sql("base_player_games", """
select person_id,
  (array_agg(v order by game_ts desc, game_id desc) filter (where v is not null))[1] as last_points
from (select person_id, game_ts, game_id, case when game_id % 7 = 0 then null else points end as v
      from base_player_games)
group by person_id"""))
def q_agg_last_by_order(spark, sf_dir):
    """Last non-NULL value by order per group: a partial-aggregated max_by
    (the ordered array_agg … LIMIT 1 form)."""
    base = R.dedup_player_game(R.raw_player_games(Bindings(spark, sf_dir).player_line))
    v = F.when(F.col("game_id") % 7 == 0, F.lit(None)).otherwise(F.col("points"))
    return base.groupBy("person_id").agg(C.last_non_null(v, "game_ts", "game_id").alias("last_points"))


@query("agg_product", sql=ob.with_("quote") + """
select game_id, round(product(abs(price1) / (abs(price1) + 100.0)), 12) as p_all_lines
from quote group by game_id""")
def q_agg_product(spark, sf_dir):
    """Product aggregate (a zero factor gives 0, unlike exp(sum(ln)))."""
    q = Bindings(spark, sf_dir).quote
    return q.groupBy("game_id").agg(
        F.round(F.product(F.abs("price1") / (F.abs("price1") + F.lit(100.0))), 12).alias("p_all_lines"))


@query("agg_over_distinct", sql=flag_sql("gr", """
select series_id, player_team_id, opponent_team_id, count(distinct kaggle_game_id) as games,
  cast(sum(player_win) as bigint) as wins
from (select distinct series_id, kaggle_game_id, player_team_id, opponent_team_id, player_win from gr)
group by 1, 2, 3"""))
def q_agg_over_distinct(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    g = RP.residual_tables(b.player_line, b.elo_games, columns=[]).games
    d = g.select("series_id", "kaggle_game_id", "player_team_id", "opponent_team_id", "player_win").distinct()
    return d.groupBy("series_id", "player_team_id", "opponent_team_id").agg(
        F.count_distinct("kaggle_game_id").alias("games"), F.sum("player_win").alias("wins"))


@query("agg_majority", sql=ob.with_("player_line") + """
select person_id, year_id,
  case when sum(win) > sum(1 - win) then 1 when sum(win) < sum(1 - win) then 0 end as majority_win
from player_line group by 1, 2""")
def q_agg_majority(spark, sf_dir):
    """Compare two sums: 1, 0, or NULL on a tie."""
    p = Bindings(spark, sf_dir).player_line
    wins, losses = F.sum("win"), F.sum(F.lit(1) - F.col("win"))
    return p.groupBy("person_id", "year_id").agg(
        F.when(wins > losses, 1).when(wins < losses, 0).alias("majority_win"))


@query("union_all_sides", sql=ob.with_("quote") + """
select game_id, team_id as target_team_id, avg(price1) as avg_price from quote group by 1, 2
union all
select game_id, a_team_id as target_team_id, avg(price2) as avg_price from quote group by 1, 2""")
def q_union_all_sides(spark, sf_dir):
    """UNION ALL of the home-side and away-side aggregates."""
    q = Bindings(spark, sf_dir).quote
    return odds_ops.side_odds(q, single_scan=False).select("game_id", "target_team_id", "avg_price")
