"""Projection, filter, CASE, scalar-function and array queries
(P-*, F-*, R-*, O-01/03/06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safe
from ..operators import identity
from . import oracle_bindings as ob
from .bindings import Bindings
from .registry import query

# -- projections and filters ---------------------------------------------------------


@query("proj_rename", sql="""
select l_orderkey as game_id, l_suppkey as book_id, l_linenumber as line_no,
  l_quantity as quantity, l_extendedprice as extended_price
from lineitem
""")
def q_proj_rename(spark, sf_dir):
    li = Bindings(spark, sf_dir).t("lineitem")
    return li.select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("book_id"),
                     F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity"),
                     F.col("l_extendedprice").alias("extended_price"))


@query("proj_star_except", sql=ob.with_("game") + """
select * exclude (forecast, nation_key, series_game_number_raw),
  case when home_team = 1 then 'CHA' else 'OTHER' end as home_code,
  season - 1 as prior_season
from game
""")
def q_proj_star_except(spark, sf_dir):
    """``* except(cols)`` plus computed columns: drop + withColumns."""
    g = Bindings(spark, sf_dir).game
    return (g.drop("forecast", "nation_key", "series_game_number_raw")
            .withColumns({"home_code": F.when(F.col("home_team") == 1, "CHA").otherwise("OTHER"),
                          "prior_season": F.col("season") - 1}))


@query("proj_literals", sql=ob.with_("game") + """
select game_id, 0 as is_copy, 1 as is_playoffs, cast(null as double) as win_equiv,
  'H' as game_location, cast(null as varchar) as notes, season as year_id
from game
""")
def q_proj_literals(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    return g.select("game_id", F.lit(0).alias("is_copy"), F.lit(1).alias("is_playoffs"),
                    F.lit(None).cast("double").alias("win_equiv"), F.lit("H").alias("game_location"),
                    F.lit(None).cast("string").alias("notes"), F.col("season").alias("year_id"))


@query("filter_eq", sql=ob.with_("game") + """
select game_id, season, game_label from game
where game_type = 'Playoffs' and home_team = 2
""")
def q_filter_eq(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    return (g.where((F.col("game_type") == "Playoffs") & (F.col("home_team") == 2))
            .select("game_id", "season", "game_label"))


@query("filter_not_null", sql=ob.with_("game") + """
select game_id, forecast from game
where forecast is not null and forecast > 0 and forecast < 1 and game_label is not null
""")
def q_filter_not_null(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    p = F.col("forecast")
    return (g.where(p.isNotNull() & (p > 0) & (p < 1) & F.col("game_label").isNotNull())
            .select("game_id", "forecast"))


@query("filter_in_like", sql=ob.with_("game") + """
select game_id, season, game_label from game
where season in (1977, 1980, 1995, 2001, 2013)
  and lower(game_label) like '%first%' and game_label not like 'West%'
  or (season between 1984 and 2002 and game_label like '%Semis')
""")
def q_filter_in_like(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    lab = F.col("game_label")
    cond = ((F.col("season").isin(1977, 1980, 1995, 2001, 2013)
             & F.lower(lab).like("%first%") & ~lab.like("West%"))
            | (F.col("season").between(1984, 2002) & lab.like("%Semis")))
    return g.where(cond).select("game_id", "season", "game_label")


@query("case_result_flag", sql=ob.with_("game") + """
select game_id,
  case when game_result = 'W' then 1 when game_result = 'L' then 0 end as elo_team_win,
  case when forecast >= 0.5 then 'favourite' when forecast < 0.5 then 'underdog' end as side
from game
""")
def q_case_result_flag(spark, sf_dir):
    """Searched CASE without ELSE: unmatched rows (NULL forecast) give NULL."""
    g = Bindings(spark, sf_dir).game
    return g.select("game_id",
                    F.when(F.col("game_result") == "W", 1).when(F.col("game_result") == "L", 0)
                    .alias("elo_team_win"),
                    F.when(F.col("forecast") >= 0.5, "favourite")
                    .when(F.col("forecast") < 0.5, "underdog").alias("side"))


@query("distinct_rows", sql=ob.with_("game") + """
select distinct season, game_type, game_label from game
""")
def q_distinct_rows(spark, sf_dir):
    return Bindings(spark, sf_dir).game.select("season", "game_type", "game_label").distinct()


@query("sort_multi_key", sql=ob.with_("game") + """
select game_id, season, game_date, forecast from game
order by season desc, game_date asc, game_id desc
""")
def q_sort_multi_key(spark, sf_dir):
    g = Bindings(spark, sf_dir).game.select("game_id", "season", "game_date", "forecast")
    return g.orderBy(F.col("season").desc(), F.col("game_date").asc(), F.col("game_id").desc())


@query("topk_metric", sql=ob.with_("game") + """
select game_id, forecast from game where forecast is not null
order by forecast desc, game_id asc limit 20
""")
def q_topk_metric(spark, sf_dir):
    """Top-k report: ORDER BY + LIMIT plans as TakeOrderedAndProject (a
    per-partition top-k, then a k-row merge), never a global sort."""
    g = Bindings(spark, sf_dir).game.where(F.col("forecast").isNotNull())
    return g.select("game_id", "forecast").orderBy(F.col("forecast").desc(), "game_id").limit(20)


# -- scalar functions ----------------------------------------------------------------

INT_GUARD = "regexp_full_match(trim({x}), '[+-]?[0-9]+')"
NUM_GUARD = "regexp_full_match(trim({x}), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')"


@query("fn_safe_cast", sql=ob.with_("raw_stat") + f"""
select game_id, line_no, pts_raw,
  case when {INT_GUARD.format(x='pts_raw')} then cast(trim(pts_raw) as bigint) end as pts_int,
  case when {NUM_GUARD.format(x='pts_raw')} then cast(trim(pts_raw) as double) end as pts_double,
  case when lower(trim(game_no_raw)) = 'true' then true when lower(trim(game_no_raw)) = 'false' then false
       end as game_no_bool,
  case when {INT_GUARD.format(x='game_no_raw')} then cast(trim(game_no_raw) as bigint) end as game_no_int
from raw_stat
""")
def q_fn_safe_cast(spark, sf_dir):
    r = Bindings(spark, sf_dir).raw_stat
    return r.select("game_id", "line_no", "pts_raw",
                    safe.safe_cast("pts_raw", "bigint").alias("pts_int"),
                    safe.safe_cast("pts_raw", "double").alias("pts_double"),
                    safe.safe_cast("game_no_raw", "boolean").alias("game_no_bool"),
                    safe.safe_cast("game_no_raw", "bigint").alias("game_no_int"))


@query("fn_round_cast", sql=ob.with_("raw_stat") + f"""
select game_id, line_no,
  case when {NUM_GUARD.format(x="replace(pts_raw, '+', '')")}
       then cast(round(cast(trim(replace(pts_raw, '+', '')) as double)) as bigint) end as pts
from raw_stat
""")
def q_fn_round_cast(spark, sf_dir):
    """Parse as double, round half away from zero, then bigint; '+' stripped."""
    r = Bindings(spark, sf_dir).raw_stat
    return r.select("game_id", "line_no", safe.round_cast("pts_raw", strip_plus=True).alias("pts"))


@query("fn_label_cleanup", sql=ob.with_("game") + """
select game_id, case when game_label is null then null else replace(game_label, '- ', '') end as game_label
from game
""")
def q_fn_label_cleanup(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    return g.select("game_id", safe.label_cleanup("game_label").alias("game_label"))


@query("fn_game_number", sql=ob.with_("raw_stat") + """
select game_id, line_no,
  cast(case when game_no_raw like '%1%' then '1' else game_no_raw end as double) as series_game_number
from raw_stat
where game_no_raw is null or regexp_full_match(game_no_raw, '[0-9]+')
""")
def q_fn_game_number(spark, sf_dir):
    """Any number containing a 1 becomes 1 (faithful), then a hard cast."""
    r = Bindings(spark, sf_dir).raw_stat
    r = r.where(F.col("game_no_raw").isNull() | F.col("game_no_raw").rlike("^[0-9]+$"))
    return r.select("game_id", "line_no", safe.game_number_fix("game_no_raw").alias("series_game_number"))


@query("fn_normalize_key", sql=ob.with_("game_code") + """
select game_id, upper(trim(team_code)) as team_key, lower(trim(fran)) as fran_key from game_code
""")
def q_fn_normalize_key(spark, sf_dir):
    c = Bindings(spark, sf_dir).game_code
    return c.select("game_id", safe.normalize_key("team_code", "upper").alias("team_key"),
                    safe.normalize_key("fran", "lower").alias("fran_key"))


@query("fn_slug", sql=ob.with_("game") + """
select game_id,
  regexp_replace(lower(cast(year(game_date) as varchar) || game_label), '[^a-z0-9]', '', 'g') as series_id
from game
""")
def q_fn_slug(spark, sf_dir):
    """Short series key: slug(year ‖ label); NULL label → NULL id."""
    g = Bindings(spark, sf_dir).game
    return g.select("game_id", safe.slug(F.concat(F.year("game_date").cast("string"),
                                                  F.col("game_label"))).alias("series_id"))


@query("fn_extract_digits", sql=ob.with_("raw_stat") + """
select game_id, line_no,
  try_cast(nullif(regexp_extract(game_no_raw, '[0-9]+', 0), '') as bigint) as series_game_number
from raw_stat
""")
def q_fn_extract_digits(spark, sf_dir):
    r = Bindings(spark, sf_dir).raw_stat
    return r.select("game_id", "line_no", safe.extract_digits("game_no_raw").alias("series_game_number"))


@query("fn_date_parts", sql=ob.with_("game") + """
select game_id, cast(year(game_ts) as int) as year_id, cast(game_ts as date) as game_day,
  cast(month(game_ts) as int) as month_id
from game
""")
def q_fn_date_parts(spark, sf_dir):
    g = Bindings(spark, sf_dir).game
    return g.select("game_id", F.year("game_ts").alias("year_id"), F.to_date("game_ts").alias("game_day"),
                    F.month("game_ts").alias("month_id"))


def _date_strings(b: Bindings):
    o = b.t("orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    s = (F.when(k % 3 == 0, d.cast("date").cast("string"))
         .when(k % 3 == 1, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                                       F.dayofmonth(d).cast("string")))
         .otherwise(F.lit("not a date")))
    return o.select(k.alias("row_id"), s.alias("date_raw"))


@query("fn_parse_date", sql="""
with s as (
  select o_orderkey as row_id,
    case when o_orderkey % 3 = 0 then cast(cast(o_orderdate as date) as varchar)
         when o_orderkey % 3 = 1 then cast(year(o_orderdate) as varchar) || '-' || cast(month(o_orderdate) as varchar)
                                      || '-' || cast(day(o_orderdate) as varchar)
         else 'not a date' end as date_raw
  from orders)
select row_id, date_raw,
  case when regexp_full_match(date_raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(date_raw as date) end as date_game
from s
""")
def q_fn_parse_date(spark, sf_dir):
    """Strict yyyy-MM-dd parse: unpadded or malformed strings give NULL."""
    s = _date_strings(Bindings(spark, sf_dir))
    return s.select("row_id", "date_raw", safe.parse_date("date_raw").alias("date_game"))


@query("fn_least_greatest", sql=ob.with_("player_line", extra=[("p", """
  select game_id, person_id, player_team_id,
    case when game_id % 5 = 0 then null else opponent_team_id end as opp from player_line""")]) + """
select game_id, person_id,
  case when player_team_id is null or opp is null then null else least(player_team_id, opp) end as lo,
  case when player_team_id is null or opp is null then null else greatest(player_team_id, opp) end as hi
from p
""")
def q_fn_least_greatest(spark, sf_dir):
    """least/greatest that propagate NULL (Spark's skip NULLs)."""
    p = Bindings(spark, sf_dir).player_line
    opp = F.when(F.col("game_id") % 5 == 0, F.lit(None)).otherwise(F.col("opponent_team_id"))
    return p.select("game_id", "person_id", safe.least_nn("player_team_id", opp).alias("lo"),
                    safe.greatest_nn("player_team_id", opp).alias("hi"))


@query("fn_math", sql=ob.with_("quote_raw", "game", extra=[("j", """
  select q.game_id, q.book_id, q.line_no, q.price1, g.forecast
  from quote_raw q join game g on q.game_id = g.game_id""")]) + """
select game_id, book_id, line_no, abs(price1) as abs_price,
  round(case when forecast > 0 then ln(forecast) end, 10) as ln_p,
  round(exp(forecast), 10) as exp_p,
  cast(pow(2, 7 - line_no) as bigint) as paths,
  game_id % 7 as game_mod, game_id // 7 as game_div
from j
""")
def q_fn_math(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    j = b.quote_raw.join(b.game.select("game_id", "forecast"), "game_id")
    p = F.col("forecast")
    return j.select("game_id", "book_id", "line_no", F.abs("price1").alias("abs_price"),
                    F.round(F.when(p > 0, F.log(p)), 10).alias("ln_p"),
                    F.round(F.exp(p), 10).alias("exp_p"),
                    F.pow(F.lit(2), F.lit(7) - F.col("line_no")).cast("bigint").alias("paths"),
                    (F.col("game_id") % 7).alias("game_mod"),
                    F.expr("game_id div 7").alias("game_div"))


@query("fn_safe_divide", sql=ob.with_("player_line") + """
select game_id, person_id, points / nullif(turnovers, 0) as points_per_turnover,
  cast(field_goals_made as double) / nullif(field_goals_attempted, 0) as fg_pct
from player_line
""")
def q_fn_safe_divide(spark, sf_dir):
    p = Bindings(spark, sf_dir).player_line
    return p.select("game_id", "person_id",
                    safe.safe_divide(F.col("points"), F.col("turnovers")).alias("points_per_turnover"),
                    safe.safe_divide(F.col("field_goals_made"), F.col("field_goals_attempted"))
                    .alias("fg_pct"))


@query("fn_null_sentinel", sql=ob.with_("series_quote") + """
select series_key,
  case when home_odds = 'N/A' then null else try_cast(home_odds as double) end as home_odds,
  case when away_odds = 'N/A' then null else try_cast(away_odds as double) end as away_odds
from series_quote
""")
def q_fn_null_sentinel(spark, sf_dir):
    q = Bindings(spark, sf_dir).series_quote
    return q.select("series_key", safe.null_if_sentinel("home_odds").alias("home_odds"),
                    safe.null_if_sentinel("away_odds").alias("away_odds"))


@query("fn_full_name", sql=ob.with_("player_line") + """
select game_id, person_id,
  trim(coalesce(first_name, '') || ' ' ||
       coalesce(case when person_id % 3 = 0 then null else last_name end, '')) as player_name
from player_line
""")
def q_fn_full_name(spark, sf_dir):
    p = Bindings(spark, sf_dir).player_line
    last = F.when(F.col("person_id") % 3 == 0, F.lit(None)).otherwise(F.col("last_name"))
    return p.select("game_id", "person_id", safe.full_name("first_name", last).alias("player_name"))


# Abbreviation remaps of relocated franchises.
CODE_REMAP = {"CHH": "CHA", "WSB": "WAS"}


@query("fn_remap_code", sql="""
with c as (
  select o_orderkey as game_id,
    case o_orderkey % 4 when 0 then 'CHH' when 1 then 'WSB' when 2 then 'BOS' end as team_code
  from orders)
select game_id, team_code,
  case when team_code = 'CHH' then 'CHA' when team_code = 'WSB' then 'WAS' else team_code end as team_id
from c
""")
def q_fn_remap_code(spark, sf_dir):
    o = Bindings(spark, sf_dir).t("orders").select("o_orderkey")
    k = F.col("o_orderkey")
    c = o.select(k.alias("game_id"),
                 F.when(k % 4 == 0, "CHH").when(k % 4 == 1, "WSB").when(k % 4 == 2, "BOS")
                 .alias("team_code"))
    return c.select("game_id", "team_code", safe.remap_values("team_code", CODE_REMAP).alias("team_id"))


@query("arr_split_slice_join", sql="""
with t as (
  select o_orderkey as row_id,
    string_split(list_extract(['Spirits of St. Louis', 'Fort Wayne Pistons', 'Golden State Warriors',
      'Kansas City-Omaha Kings', 'Kansas City Kings', 'Los Angeles Lakers', 'New Jersey Nets',
      'New Orleans/Oklahoma City Hornets', 'New Orleans Jazz', 'New York Knicks', 'Oklahoma City Thunder',
      'San Antonio Spurs', 'San Diego Clippers', 'San Francisco Warriors', 'St. Louis Hawks',
      'Portland Trail Blazers', 'Providence Steam Rollers', 'Sheboygan Red Skins', 'Boston Celtics'],
      cast(o_orderkey % 19 + 1 as integer)), ' ') as parts
  from orders)
select row_id, parts[1] as first_part, parts[4] as fourth_part,
  array_to_string(parts[3:], ' ') as tail_from_2, cast(len(parts) as int) as n_parts
from t
""")
def q_arr_split_slice_join(spark, sf_dir):
    """split; 0-based NULL-safe access; 0-based slice to the end; join."""
    t = Bindings(spark, sf_dir).team_name_rows
    parts = F.split("full_team_name", " ", -1)
    return t.select("row_id", safe.element0(parts, 0).alias("first_part"),
                    safe.element0(parts, 3).alias("fourth_part"),
                    F.array_join(safe.slice0(parts, 2), " ").alias("tail_from_2"),
                    F.size(parts).alias("n_parts"))


# Full team names as they come, cut between city and nickname.
PARSED_TEAM_NAMES = [
    ("Spirits of St. Louis", "St. Louis", "Spirits"), ("Fort Wayne Pistons", "Fort Wayne", "Pistons"),
    ("Golden State Warriors", "Golden State", "Warriors"), ("Kansas City-Omaha Kings", "Kansas City-Omaha", "City-Omaha Kings"),
    ("Kansas City Kings", "Kansas City", "Kings"), ("Los Angeles Lakers", "Los Angeles", "Lakers"),
    ("New Jersey Nets", "New Jersey", "Nets"),
    ("New Orleans/Oklahoma City Hornets", "New Orleans/Oklahoma City", "Hornets"),
    ("New Orleans Jazz", "New Orleans", "Jazz"), ("New York Knicks", "New York", "Knicks"),
    ("Oklahoma City Thunder", "Oklahoma City", "Thunder"), ("San Antonio Spurs", "San Antonio", "Spurs"),
    ("San Diego Clippers", "San Diego", "Clippers"), ("San Francisco Warriors", "San Francisco", "Warriors"),
    ("St. Louis Hawks", "St. Louis", "Hawks"), ("Portland Trail Blazers", "Portland", "Trail Blazers"),
    ("Providence Steam Rollers", "Providence", "Steam Rollers"), ("Sheboygan Red Skins", "Sheboygan", "Red Skins"),
    ("Boston Celtics", "Boston", "Celtics"),
]


@query("parse_team_name", sql="""
select o_orderkey as row_id, full_team_name, team_city, team_name
from orders join (values """ + ", ".join(f"({i}, '{f}', '{c}', '{n}')" for i, (f, c, n) in enumerate(PARSED_TEAM_NAMES)) + """)
  parsed(place, full_team_name, team_city, team_name) on o_orderkey % """ + str(len(PARSED_TEAM_NAMES)) + """ = place""")
def q_parse_team_name(spark, sf_dir):
    t = Bindings(spark, sf_dir).team_name_rows
    city, name = identity.parse_team_name("full_team_name")
    return t.select("row_id", "full_team_name", city.alias("team_city"), name.alias("team_name"))
