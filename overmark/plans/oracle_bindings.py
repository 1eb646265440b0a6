"""The same domain bindings as ``bindings.py``, as DuckDB SQL CTE bodies.

Used only by the independent SQL oracle (``oracle_sql`` in the entry
module); the Spark side never reads these strings.
"""

from __future__ import annotations

LABEL_CASE = """case o_orderpriority
      when '1-URGENT' then 'East - First Round'
      when '2-HIGH' then 'West - First Round'
      when '3-MEDIUM' then 'East - Conf. Finals'
      when '4-NOT SPECIFIED' then 'West - Conf. Semis' end"""

SEASON = """cast(year(o_orderdate) as bigint)
      + case o_custkey % 3 when 0 then -18 when 1 then 0 else 18 end"""

CTES = {
    "game": f"""
    select o_orderkey as game_id,
      cast(o_orderdate as date) as game_date,
      cast(o_orderdate as timestamp) as game_ts,
      {SEASON} as season,
      cast(c_nationkey % 4 as bigint) as home_team,
      cast((c_nationkey + 1 + o_orderkey % 3) % 4 as bigint) as away_team,
      case when o_orderpriority = '5-LOW' then 'Regular Season' else 'Playoffs' end as game_type,
      {LABEL_CASE} as game_label,
      case when o_orderkey % 97 = 0 then cast(null as double)
           when o_orderkey % 101 = 0 then cast(1.0 as double)
           else cast(1 + (o_orderkey * 7919) % 998 as double) / cast(1000.0 as double) end as forecast,
      case when (o_orderkey * 31) % 100 < 60 then 'W' else 'L' end as game_result,
      'Game ' || cast(o_orderkey % 7 + 1 as varchar) as series_game_number_raw,
      c_nationkey as nation_key
    from orders join customer on o_custkey = c_custkey""",
    "numbered": """
    select *, row_number() over (
      partition by game_date, least(home_team, away_team), greatest(home_team, away_team) order by game_id) as rn
    from game""",
    "game_first": "select * exclude (rn) from numbered where rn = 1",
    "game1": """
    select * exclude (rn) replace (cast(home_team + 4 * (rn - 1) as bigint) as home_team,
      cast(away_team + 4 * (rn - 1) as bigint) as away_team,
      cast(year(game_date) as bigint) + 18 * ((home_team + away_team + 8 * (rn - 1)) % 3 - 1) as season)
    from numbered""",
    "game_sides": """
    select game_id, game_date, game_type, game_label, season,
      home_team as team_id, true as is_home, game_result as wl from game1
    union all
    select game_id, game_date, game_type, game_label, season,
      away_team as team_id, false as is_home,
      case game_result when 'W' then 'L' when 'L' then 'W' end as wl from game1""",
    "games_all": """
    select game_id, game_date,
      'G' || cast(game_id as varchar) || case when is_home then ' home' else ' away' end as matchup,
      team_id,
      cast(80 + (game_id * case when is_home then 1 else 7 end) % 41 as bigint) as pts,
      wl, season as season_year, game_type as season_type, cast(season as varchar) as season,
      is_home
    from game_sides""",
    "team_stat": """
    select game_id, team_id,
      cast(case when wl = 'W' then 1 when wl = 'L' then 0 end as bigint) as win
    from game_sides""",
    "elo_games": """
    select cast(game_id as varchar) as game_id, game_date as date_game, season as year_id,
      'T' || cast(home_team as varchar) as team_id, 'T' || cast(away_team as varchar) as opp_id,
      'Club ' || cast(home_team as varchar) as fran_id, 'Club ' || cast(away_team as varchar) as opp_fran,
      cast(80 + game_id % 41 as bigint) as pts, cast(80 + (game_id * 7) % 41 as bigint) as opp_pts,
      cast(1400 + game_id % 200 as double) as elo_i, cast(1405 + game_id % 200 as double) as elo_n,
      cast(1450 + game_id % 150 as double) as opp_elo_i, cast(1445 + game_id % 150 as double) as opp_elo_n,
      cast(41 + game_id % 10 as double) as win_equiv, 'H' as game_location,
      game_result, forecast, home_team as kaggle_team_id, away_team as kaggle_opp_team_id,
      home_team as kaggle_home_team_id
    from game1 where game_type = 'Playoffs'""",
    "quote_raw": """
    select l_orderkey as game_id, l_suppkey as book_id, l_linenumber as line_no,
      case when l_linenumber = 7 then cast(0 as double)
           when l_linenumber % 2 = 0 then -(100.0 + 5.0 * l_quantity)
           else 100.0 + 5.0 * l_quantity end as price1,
      case when l_linenumber = 6 then cast(null as double)
           when l_linenumber % 2 = 0 then 100.0 + 5.0 * l_quantity
           else -(100.0 + 5.0 * l_quantity) end as price2
    from lineitem""",
    "quote": """
    select q.*, g.home_team as team_id, g.away_team as a_team_id
    from quote_raw q join game1 g on q.game_id = g.game_id""",
    "player_line": """
    select person_id, 'P' || cast(person_id as varchar) as first_name, 'L' || cast(person_id as varchar) as last_name,
      g.game_id,
      case when person_id % 2 = 0 then home_team else away_team end as player_team_id,
      case when person_id % 2 = 0 then away_team else home_team end as opponent_team_id,
      cast(case when person_id % 2 = 0 then 1 else 0 end as bigint) as player_home,
      cast(case when person_id % 2 = 0 then (case when game_result = 'W' then 1 else 0 end)
                else (case when game_result = 'W' then 0 else 1 end) end as bigint) as win,
      l_quantity as num_minutes,
      cast(l_quantity as bigint) as points,
      cast(l_linenumber as bigint) as assists,
      l_partkey % 15 as rebounds_total,
      l_partkey % 4 as blocks,
      l_suppkey % 3 as steals,
      cast(l_quantity as bigint) as field_goals_attempted,
      cast(floor(l_quantity / 2) as bigint) as field_goals_made,
      cast(l_linenumber % 3 as bigint) as turnovers,
      game_type, game_label, game_ts, game_date,
      game_ts as game_date_time_est,
      series_game_number_raw as series_game_number,
      season as year_id
    from (select *, cast(case when (l_orderkey + l_linenumber) % 3 = 0 then 0 when l_suppkey % 4 < 2 then l_suppkey * 100
        when l_suppkey % 4 = 2 then l_suppkey * 100 + l_orderkey % 8 else l_suppkey * 100 + l_orderkey % 40 end as bigint)
        as person_id from lineitem) join game1 g on l_orderkey = g.game_id
    where g.game_type = 'Playoffs'""",
    "raw_stat": """
    select l_orderkey as game_id, l_linenumber as line_no,
      case l_linenumber
        when 1 then cast(cast(l_quantity as bigint) as varchar) || '.0'
        when 2 then 'N/A'
        when 3 then '+' || cast(cast(l_quantity as bigint) as varchar)
        when 4 then ''
        when 5 then cast(cast(l_quantity as bigint) as varchar) || '.5'
        else cast(cast(l_quantity as bigint) as varchar) end as pts_raw,
      case l_linenumber
        when 1 then 'Game 7' when 2 then '12' when 3 then cast(null as varchar)
        when 4 then 'Final' else cast(l_linenumber as varchar) end as game_no_raw
    from lineitem""",
    "team_hist": """
    select cast(1000 + n_nationkey as bigint) as team_id, 'T' || cast(n_nationkey as varchar) as team_abbrev,
      upper('club ' || cast(n_nationkey as varchar)) as team_name,
      cast(1970 as bigint) as season_founded, cast(1989 as bigint) as season_active_till
    from nation where n_nationkey < 4
    union all
    select cast(1000 + n_nationkey as bigint), 'T' || cast(n_nationkey as varchar),
      upper('club ' || cast(n_nationkey as varchar)), cast(1990 as bigint), cast(null as bigint)
    from nation where n_nationkey < 3""",
    "game_code": f"""
    select o_orderkey as game_id,
      {SEASON} as season,
      case when o_orderkey % 5 = 0 then 'ZZZ'
           else 't' || cast(c_nationkey % 4 as varchar) || ' ' end as team_code,
      'Club ' || cast(c_nationkey % 4 as varchar) as fran,
      cast(o_orderdate as date) as game_date
    from orders join customer on o_custkey = c_custkey""",
    "series_quote": f"""
    select o_orderkey as series_key, cast(year(o_orderdate) as bigint) as year,
      {LABEL_CASE} as round,
      case when o_orderkey % 11 = 0 then 'N/A' when o_orderkey % 13 = 0 then '0'
           when o_orderkey % 2 = 0 then '-' || cast(100 + o_orderkey % 400 as varchar)
           else cast(100 + o_orderkey % 400 as varchar) end as home_odds,
      case when o_orderkey % 7 = 0 then 'N/A' when o_orderkey % 17 = 0 then '0'
           when o_orderkey % 2 = 1 then '-' || cast(100 + o_orderkey % 300 as varchar)
           else cast(100 + o_orderkey % 300 as varchar) end as away_odds
    from orders""",
}

DEPS = {
    "game": [], "numbered": ["game"], "game_first": ["numbered"], "game1": ["numbered"], "game_sides": ["game1"], "quote_raw": [],
    "games_all": ["game_sides"], "elo_games": ["game1"], "team_stat": ["game_sides"],
    "quote": ["quote_raw", "game1"], "player_line": ["game1"], "raw_stat": [],
    "team_hist": [], "game_code": [], "series_quote": [],
}


def with_(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """A WITH clause holding the named bindings (and their dependencies) in
    dependency order, followed by ``extra`` (name, body) CTEs."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({CTES[n]}\n)" for n in order]
    parts += [f"{n} as ({body}\n)" for n, body in (extra or [])]
    return "with " + ",\n".join(parts) + "\n"
