"""The domain bindings reproduce the counts recorded in FIXTURES.md Part B."""

from pyspark.sql import functions as F

from overmark.functions import safe
from overmark.plans.bindings import Bindings

from conftest import SF_CHECK


def test_game_and_game1(spark):
    b = Bindings(spark, SF_CHECK)
    g = b.game
    assert g.count() == 15000 and g.select("game_id").distinct().count() == 15000
    assert g.where(F.col("forecast").isNull()).count() == 155
    assert g.where(F.col("forecast") == 1.0).count() == 147
    assert g.where(F.col("home_team") == F.col("away_team")).count() == 0
    assert b.game_first.count() == 9304
    g1 = b.game1
    assert g1.count() == 15000
    pair = [F.least("home_team", "away_team"), F.greatest("home_team", "away_team")]
    assert g1.groupBy("game_date", *pair).count().where("count > 1").count() == 0
    one = g1.groupBy(F.year("game_date"), *pair).agg(F.count_distinct("season").alias("n"))
    assert one.where("n > 1").count() == 0


def test_quote(spark):
    q = Bindings(spark, SF_CHECK).quote
    assert q.count() == 60000
    assert q.where(F.col("price1") == 0).count() == 8598
    assert q.where(F.col("price2").isNull()).count() == 8662


def test_player_line(spark):
    p = Bindings(spark, SF_CHECK).player_line
    assert p.count() == 47983
    assert p.select("person_id").distinct().count() == 1249
    assert p.where("person_id = 0").count() == 16357
    assert p.groupBy("person_id", "game_id").agg(F.count_distinct("player_home").alias("n")).where("n > 1").count() == 0
    dup = p.groupBy("person_id", "game_id").count().where("count > 1").count()
    assert dup == 5109


def test_raw_stat_safe_int(spark):
    r = Bindings(spark, SF_CHECK).raw_stat
    row = r.select(safe.safe_cast("pts_raw", "bigint").alias("v")).agg(F.count("v"), F.sum("v")).first()
    assert (row[0], row[1]) == (25749, 655275)


def test_series_quote_sentinels(spark):
    s = Bindings(spark, SF_CHECK).series_quote
    assert s.where(F.col("home_odds") == "N/A").count() == 1364
    assert s.where(F.col("home_odds") == "0").count() == 1049
    assert s.where(F.col("home_odds").startswith("-")).count() == 6294


def test_name_fallback_matches(spark):
    b = Bindings(spark, SF_CHECK)
    zzz = b.game_code.where(F.col("team_code") == "ZZZ")
    h = b.team_hist.select("team_id", "team_name", "season_founded",
                           F.coalesce("season_active_till", F.lit(2100)).alias("till"))
    j = zzz.join(h, (F.upper(F.trim("fran")) == F.col("team_name"))
                 & F.col("season").between(F.col("season_founded"), F.col("till")), "left")
    assert zzz.count() == 3000
    assert j.where(F.col("team_id").isNotNull()).count() == 2437
