"""Window queries (W-01 … W-12).

Per-key cumulative windows go through the prefix scan of
``operators.prefix`` (a hot key is cut into range pieces); windows whose
partition is one small group (a series, a game-date pair) use plain
``Window`` specs.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import common as C
from ..operators import residual as R
from ..sources.catalog import test_catalog
from . import oracle_bindings as ob
from .bindings import Bindings
from .q_reports import flag_sql
from .registry import query


def _events(spark, sf_dir):
    return test_catalog(spark, sf_dir).scan("events").select("event_id", "ts", "user_id", "value")


@query("win_partition_min", sql=flag_sql("raw_player_games", """
select person_id, game_id, series_id,
  min(game_ts) over (partition by person_id, series_id) as series_start_ts
from raw_player_games"""))
def q_win_partition_min(spark, sf_dir):
    raw = R.raw_player_games(Bindings(spark, sf_dir).player_line)
    w = W.partitionBy("person_id", "series_id")
    return raw.select("person_id", "game_id", "series_id", F.min("game_ts").over(w).alias("series_start_ts"))


@query("win_running_rows", sql="""
select event_id, user_id, ts,
  round(sum(value) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and current row), 4) as running_value
from events""")
def q_win_running_rows(spark, sf_dir):
    """Running sum, explicit ROWS frame, rounded like the warehouse models."""
    e = C.running_sum(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", "_r", "rows")
    return e.select("event_id", "user_id", "ts", F.round("_r", 4).alias("running_value"))


@query("win_running_range", sql="""
select event_id, user_id, cast(ts as date) as day,
  round(sum(value) over (partition by user_id order by cast(ts as date)), 4) as running_value
from events""")
def q_win_running_range(spark, sf_dir):
    """Default frame (RANGE … CURRENT ROW): rows of the same day are peers
    and share the running total."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    e = C.running_sum(e, ["user_id"], ["day"], "value", "_r", "range")
    return e.select("event_id", "user_id", "day", F.round("_r", 4).alias("running_value"))


@query("win_running_avg", sql="""
select event_id, user_id, cast(ts as date) as day,
  round(avg(value) over (partition by user_id order by cast(ts as date)), 9) as running_avg
from events""")
def q_win_running_avg(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    e = C.running_avg(e, ["user_id"], ["day"], "value", "_a", "range")
    return e.select("event_id", "user_id", "day", F.round("_a", 9).alias("running_avg"))


@query("win_constant_order", sql=flag_sql("player_playoff_games", """
select person_id, game_id, series_id,
  round(sum(num_minutes) over (partition by person_id, series_id order by series_start_ts), 4) as series_minutes,
  round(avg(num_minutes) over (partition by person_id, series_id order by series_start_ts), 4) as series_avg_minutes
from player_playoff_games"""))
def q_win_constant_order(spark, sf_dir):
    """Ordering by a value constant within the partition under the default
    RANGE frame makes every row a peer: the window is the partition total.
    Computed as a (person, series) aggregate joined back."""
    base = R.with_series_start(R.dedup_player_game(R.raw_player_games(Bindings(spark, sf_dir).player_line)))
    tot = base.groupBy("person_id", "series_id").agg(
        F.round(F.sum("num_minutes"), 4).alias("series_minutes"),
        F.round(F.avg("num_minutes"), 4).alias("series_avg_minutes"))
    return base.select("person_id", "game_id", "series_id").join(tot, ["person_id", "series_id"], "left")


@query("win_dense_rank", sql=flag_sql("player_playoff_games", """
select person_id, game_id, series_start_ts,
  dense_rank() over (partition by person_id order by series_start_ts) as player_series_order
from player_playoff_games"""))
def q_win_dense_rank(spark, sf_dir):
    base = R.with_series_start(R.dedup_player_game(R.raw_player_games(Bindings(spark, sf_dir).player_line)))
    out = C.dense_rank_by(base.select("person_id", "game_id", "series_start_ts"), ["person_id"],
                          "series_start_ts", "player_series_order")
    return out


@query("win_first_per_group", sql=ob.with_("game_first") + """
select game_id, game_date, home_team, away_team from game_first""")
def q_win_first_per_group(spark, sf_dir):
    """``qualify row_number() = 1`` per (date, unordered pair): plans as a
    WindowGroupLimit (partial top-1 before the shuffle)."""
    return Bindings(spark, sf_dir).game_first.select("game_id", "game_date", "home_team", "away_team")


@query("win_priority_pick", sql=ob.with_("game_code", "team_hist", extra=[("c", """
  select g.game_id, g.team_code, h.team_id, h.season_founded,
    row_number() over (partition by g.game_id
      order by case when upper(trim(g.team_code)) = h.team_abbrev then 0 else 1 end, h.season_founded desc) as rn
  from game_code g join team_hist h on upper(trim(g.fran)) = h.team_name""")]) + """
select game_id, team_code, team_id, season_founded from c where rn = 1""")
def q_win_priority_pick(spark, sf_dir):
    """Top-1 per game by a CASE priority (abbreviation match first), then the
    latest founding season."""
    b = Bindings(spark, sf_dir)
    h = b.team_hist
    j = b.game_code.join(h, F.upper(F.trim(b.game_code["fran"])) == h["team_name"], "inner")
    prio = F.when(F.upper(F.trim("team_code")) == F.col("team_abbrev"), 0).otherwise(1)
    w = W.partitionBy("game_id").orderBy(prio, F.col("season_founded").desc())
    return (j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("game_id", "team_code", "team_id", "season_founded"))


@query("win_cumsum_null_passthrough", sql="""
with e as (select event_id, user_id, ts, case when event_id % 10 = 0 then null else value end as v from events)
select event_id, user_id, v,
  case when v is null then null else round(sum(v) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and current row), 4) end as cumulative_value
from e""")
def q_win_cumsum_null_passthrough(spark, sf_dir):
    """A NULL row keeps NULL (a SQL running sum would fill it); later rows
    continue the sum."""
    e = _events(spark, sf_dir)
    e = e.withColumn("v", F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("value")))
    e = C.running_sum(e, ["user_id"], ["ts", "event_id"], "v", "_r", "rows")
    return e.select("event_id", "user_id", "v",
                    F.when(F.col("v").isNotNull(), F.round("_r", 4)).alias("cumulative_value"))
