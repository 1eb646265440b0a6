"""Eligibility, series start and career context are joined on a person's
series or years, never on the person alone; writes keep what is read."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from overmark.operators import reports as RP
from overmark.operators import residual as R


def _inputs(spark):
    """60 games, one a day, twelve a label; person 0 plays all, person 1 every other one, person 2 the first five;
    every ninth game has no year."""
    games = spark.range(60).selectExpr(
        "id", "timestamp '2001-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts", "id % 2 as h", "floor(id / 4) as s")
    persons = games.selectExpr("*", "explode(array(0, 1, 2)) as p").where("p = 0 or (p = 1 and id % 2 = 0) or (p = 2 and id < 5)")
    stats = persons.selectExpr(
        "cast(p as bigint) as person_id", "concat('P', p) as first_name", "concat('L', p) as last_name", "id as game_id",
        *[f"cast({i} + id % 5 as bigint) as {c}" for i, c in enumerate(R.STAT_COLS)], "'Playoffs' as game_type",
        "10 as player_team_id", "20 as opponent_team_id", "h as player_home",
        "case when id < 56 then concat('Round ', cast(s as int)) end as game_label",
        "ts as game_date_time_est", "concat('Game ', id % 4 + 1) as series_game_number")
    elo = games.selectExpr(
        "concat('E', id) as game_id", "to_date(ts) as date_game", "case when id % 9 = 0 then null else 2001 + id div 30 end as year_id",
        "'A' as team_id", "'B' as opp_id", "'FA' as fran_id", "'FB' as opp_fran", "90 as pts", "80 as opp_pts",
        "1500.0 as elo_i", "1501.0 as elo_n", "1490.0 as opp_elo_i", "1491.0 as opp_elo_n", "41.0 as win_equiv",
        "cast(0.4 + (id % 7) / 50 as double) as forecast", "if(id % 3 = 0, 'L', 'W') as game_result",
        "10 as kaggle_team_id", "20 as kaggle_opp_team_id")
    return stats, elo


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_eligible_series_rows_are_window_and_semi_join(spark):
    rows = R.dedup_player_game(R.raw_player_games(_inputs(spark)[0]))
    rows = rows.unionByName(rows.where("person_id = 0 and game_id < 2").withColumn("person_id", F.lit(None).cast("bigint")))
    started = R.with_series_start(rows)
    want = started.join(R.eligible_persons(started, 10).select("person_id"), "person_id", "left_semi")
    got = R.eligible_series_rows(rows, 10)
    assert _rows(got) == _rows(want) and {r.person_id for r in got.collect()} == {0, 1}
    assert got.where("series_id is null and series_start_ts is null").count() == 0 < got.where("series_id is null").count()


def test_no_row_is_dealt_by_person_alone(spark):
    rows = R.dedup_player_game(R.raw_player_games(_inputs(spark)[0]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = R.eligible_series_rows(rows, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = plan.split("SortMergeJoin")[1]          # the join of the rows themselves
    assert re.search(r"^ \[person_id#\d+L, coalesce\(series_id", top)


def test_flagship_columns_and_null_years(spark):
    stats, elo = _inputs(spark)
    full = RP.player_game_residuals(stats, elo, piece_rows=20)
    assert full.columns == RP.FLAGSHIP_COLUMNS and full.select("person_id", "kaggle_game_id").distinct().count() == 90
    some = RP.player_game_residuals(stats, elo, piece_rows=20, columns=RP.ROLLUP_COLUMNS)
    assert _rows(some) == _rows(full.select(*RP.ROLLUP_COLUMNS))
    undated = full.where("year_id is null")
    assert undated.count() == undated.where(
        "year_game_residual is null and career_year_game_running_residual is null and career_game_last_cumulative_residual is not null"
        " and career_year_game_max_cumulative_residual is not null").count() > 0
    assert full.where("year_id is not null and year_game_residual is null").count() == 0
    last = {r.person_id: r for r in full.where("kaggle_game_id >= 58").orderBy("kaggle_game_id").collect()}
    for r in last.values():
        assert r.career_game_last_cumulative_residual == r.career_game_running_residual


def test_game_rows_keep_what_is_read(spark):
    stats, elo = _inputs(spark)
    t = RP.residual_tables(stats, elo, columns=["points"])
    assert t.games.columns == [*RP.RESIDUAL_COLS, "points"]
    assert t.player_series.count() == R.player_series_residuals(RP.residual_tables(stats, elo).games, t.series_res).count()


def test_market_series_totals_rank_and_peak_meet_rows_by_series(spark):
    """Against the same results stated by windows; rows without a series count for the career only."""
    stats, _ = _inputs(spark)
    team = stats.selectExpr("game_id", "player_team_id as team_id", "cast(game_id % 3 > 0 as bigint) as win").distinct()
    quotes = stats.selectExpr("game_id", "1 as book_id", "10 as team_id", "20 as a_team_id", "cast(100 + 10 * (game_id % 4) as double) as price1",
                              "cast(-120 as double) as price2").distinct()
    got = RP.market_residual_games(stats, team, quotes, piece_rows=20)
    RP.market_rows(stats, team, quotes).createOrReplaceTempView("market_rows_seen")
    want = spark.sql("""
      select person_id, game_id, round(total, 4) as cumulative_series_residual, player_series_order, peak as max_cumulative_career_game_residual
      from (select *, max(cum) over (partition by person_id) as peak from (
        select *, round(sum(_r) over (partition by person_id order by game_ts), 4) as cum,
          sum(_r) over (partition by person_id, series_id) as total,
          dense_rank() over (partition by person_id order by series_start_ts) as player_series_order from market_rows_seen))
      where series_id is not null and _r is not null""")
    assert _rows(got.select(*want.columns)) == _rows(want) and want.count() == 84
    assert {r.person_id for r in got.collect()} == {0, 1}


def _exchanges(spark, df):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return len(re.findall("Exchange hashpartitioning", df()._jdf.queryExecution().executedPlan().toString()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_series_rows_are_dealt_once_a_branch(spark):
    """First games, results and person rows are each dealt by series once; only the odds go on to the year."""
    stats, elo = _inputs(spark)
    t = RP.residual_tables(stats, elo, columns=[])
    assert _exchanges(spark, lambda: R.player_series_residuals(t.games, t.series_res)) <= 4
    base = R.dedup_player_game(R.raw_player_games(stats))
    rows = RP.materialize(base, "rows")
    assert _exchanges(spark, lambda: R.eligible_series_rows(rows, 10)) <= 4


def test_series_results_count_distinct_games(spark):
    """Against the distinct rows counted; a game seen from two starts counts twice as a result and once as a game."""
    t = RP.residual_tables(*_inputs(spark), columns=[])
    from overmark.operators import series_ops as SO
    games = t.games.unionByName(t.games.limit(7)).unionByName(t.games.where("kaggle_game_id < 3").withColumn(
        "player_win", F.lit(None).cast("int")))
    games.createOrReplaceTempView("games_seen")
    want = spark.sql("""
      select series_id, player_team_id, opponent_team_id, year_id, min(series_start_ts) as series_start_ts,
        count(distinct kaggle_game_id) as team_series_games, sum(player_win) as team_series_wins,
        sum(1 - player_win) as opponent_series_wins,
        case when sum(player_win) > sum(1 - player_win) then 1 when sum(player_win) < sum(1 - player_win) then 0 end as series_win
      from (select distinct series_id, kaggle_game_id, player_team_id, opponent_team_id, cast(year_id as bigint) as year_id,
              series_start_ts, player_win from games_seen) group by 1, 2, 3, 4""")
    assert _rows(SO.series_results(games)) == _rows(want) and want.count() > 10


def test_running_values_are_written_only_if_read(spark, monkeypatch):
    stats, elo = _inputs(spark)
    written, write = [], RP.materialize
    monkeypatch.setattr(RP, "materialize", lambda df, name, *a, **k: written.append(name) or write(df, name, *a, **k))
    RP.player_game_residuals(stats, elo, piece_rows=20, columns=RP.ROLLUP_COLUMNS)
    assert "player_game_base" in written and not [x for x in written if x.endswith("_running")]
    RP.player_game_residuals(stats, elo, piece_rows=20)
    assert sorted(x for x in written if x.endswith("_running")) == ["player_game_running", "player_series_running"]


def test_rate_rows_stay_where_the_rollup_left_them(spark):
    """The career meets the rollup's rows on the keys they are dealt by: the rollup is not dealt again."""
    stats, elo = _inputs(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ps = RP.player_series(RP.player_game_residuals(stats, elo, piece_rows=20, columns=RP.ROLLUP_COLUMNS))
        out = RP.rate_features(ps, 2, 0.0)
        rollup, rates = (len(re.findall("Exchange hashpartitioning", d._jdf.queryExecution().executedPlan().toString())) for d in (ps, out))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rates <= rollup + 4          # all of them over the narrow sides: two for the totals, one to the person and one back
    got = out.select("person_id", "series_id", "career_playoff_series", "career_playoff_minutes", "career_playoff_points")
    ps.createOrReplaceTempView("rollup_seen")
    want = spark.sql("""
      select r.person_id, r.series_id, n as career_playoff_series, minutes as career_playoff_minutes, points as career_playoff_points
      from rollup_seen r join (select person_id, count(distinct series_id) as n, sum(series_minutes) as minutes, sum(series_points) as points
                               from rollup_seen where series_minutes > 0 group by person_id) c on r.person_id = c.person_id
      where n > 2 and series_minutes > 0""")
    assert _rows(got) == _rows(want) and want.count() > 2


def test_shuffled_rows_carry_no_copies(spark, monkeypatch):
    """Neither the pieces of a running sum nor the join to the forecasts copy a column; the rollup writes no row number."""
    from overmark.operators import prefix
    stats, elo = _inputs(spark)
    written, write = {}, prefix.materialize
    monkeypatch.setattr(prefix, "materialize", lambda df, name, *a, **k: written.setdefault(name, df.columns) and write(df, name, *a, **k))
    rows = spark.range(9).selectExpr("id % 2 as p", "id as o", "cast(id as double) as v")
    got = prefix.running_sum(rows, ["p"], ["o"], "v", "run", piece_rows=3)
    assert written == {"range_pieces": ["p", "o", "v", "_piece"]}
    assert sorted(map(tuple, got.collect()))[-1] == (1, 7, 7.0, 16.0) and got.columns == ["p", "o", "v", "run"]
    over = prefix.running_sum(rows, ["p"], ["o"], "v", "v", piece_rows=3)
    assert sorted(map(tuple, over.collect()))[-1] == (1, 7, 16.0)
    names, write2 = {}, RP.materialize
    monkeypatch.setattr(RP, "materialize", lambda df, name, *a, **k: names.setdefault(name, df.columns) and write2(df, name, *a, **k))
    RP.player_game_residuals(stats, elo, piece_rows=20, columns=RP.ROLLUP_COLUMNS)
    assert RP.ROW not in names["player_game_base"] and "game_date" not in names["player_games_dedup"]


def test_timeline_rows_hold_what_the_timeline_reads(spark, monkeypatch):
    """The narrow rollup has the rows of the whole one, and neither it nor the tables below it hold a box score."""
    from overmark.operators import model as M
    from overmark.plans import q_model, q_reports
    stats, elo = _inputs(spark)
    written, write = {}, RP.materialize
    monkeypatch.setattr(RP, "materialize", lambda df, name, *a, **k: written.setdefault(name, df.columns) and write(df, name, *a, **k))
    monkeypatch.setattr(q_model, "materialize", RP.materialize)
    rolled = lambda source, columns: RP.player_series(RP.player_game_residuals(stats, elo, piece_rows=20, columns=source), columns)
    full = rolled(RP.ROLLUP_COLUMNS, None)
    assert full.columns[7:] == RP.SERIES_OUT
    written.clear()
    monkeypatch.setattr(q_model, "player_series_df", lambda spark, sf_dir, source, columns: rolled(source, columns))
    rates = RP.rate_features
    monkeypatch.setattr(RP, "rate_features", lambda ps: rates(ps, 2, 0.0))
    got = M.top_careers(q_model._timeline(spark, "unread"), 1)
    assert not {*R.STAT_COLS[1:], "field_goals_percentage"} & {*written["player_games_dedup"], *written["player_game_base"]}
    assert len(written["timeline_rows"]) == 10 and "rate_sides" in written
    want = M.top_careers(M.player_timeline(rates(full, 2, 0.0)), 1)
    assert _rows(got) == _rows(want.select(*got.columns)) and want.count() > 2
    assert {"series_points_per_36", "career_playoff_points", "series_rebounds_per_36"} <= {*want.columns}
