"""The build into the catalog: schemas, views over replaced tables, descriptions, declared orders."""

import pytest
from conftest import SF_SMALL

from overmark.plans.build import build, schema_of
from overmark.plans.models import BUILDERS, Warehouse
from overmark.plans.raw_exports import raw_catalog
from overmark.sources import sinks


@pytest.fixture(scope="module")
def raw(spark):
    return raw_catalog(spark, SF_SMALL)


def test_schemas():
    got = {}
    for m in BUILDERS:
        got.setdefault((schema_of(m), m.startswith("stg_")), []).append(m)
    assert {k: len(v) for k, v in got.items()} == {
        ("kaggle", True): 8, ("kaggle", False): 8, ("elo", True): 7, ("elo", False): 4,
        ("betting", True): 8, ("betting", False): 7, ("custom", True): 1, ("custom", False): 5}


def test_view_shows_the_replaced_table(spark, raw):
    about = {"nba_kaggle_team_histories": ("it's a view", {"team_id": "the league's id"}),
             "stg_nba_kaggle_team_histories": ("teams", {"team_city": "a city"})}
    done = build(Warehouse(raw), ["nba_kaggle_team_histories", "nba_elo_pre_1976"], "t1_", descriptions=about)
    assert done.built == {"stg_nba_kaggle_team_histories": "table", "nba_kaggle_team_histories": "view",
                          "stg_nba_elo_pre_1976": "table", "nba_elo_pre_1976": "table"}
    view, stored = done.name_of("nba_kaggle_team_histories"), done.name_of("stg_nba_kaggle_team_histories")
    assert (view, stored) == ("t1_kaggle.nba_kaggle_team_histories", "t1_kaggle.stg_nba_kaggle_team_histories")
    assert spark.catalog.getTable(view).tableType == "VIEW" and spark.catalog.getTable(view).description == "it's a view"
    assert {c.name: c.description for c in spark.catalog.listColumns(view)}["team_id"] == "the league's id"
    n = spark.table(view).count()
    assert n == 1000
    held = spark.table(stored)                   # a reader from before the replacement keeps its rows
    sinks.publish_table(spark.table(stored).limit(7), *stored.split("."), comment="teams, fewer")
    assert spark.table(view).count() == 7 and spark.newSession().table(view).count() == 7
    assert held.count() in (7, n)
    assert spark.catalog.getTable(stored).description == "teams, fewer"
    assert {c.name: c.description for c in spark.catalog.listColumns(stored)}["team_city"] == "a city"
    build(Warehouse(raw), ["nba_kaggle_team_histories"], "t1_")
    assert spark.table(view).count() == n


def test_failed_write_leaves_the_table(spark):
    df = spark.range(5)
    full = sinks.publish_table(df, "t2_custom", "kept")
    with pytest.raises(Exception):
        sinks.publish_table(df.selectExpr("raise_error('bad row') as id").selectExpr("cast(id as bigint) id"),
                            "t2_custom", "kept")
    assert sorted(r.id for r in spark.table(full).collect()) == [0, 1, 2, 3, 4]


def test_changed_schema_and_kind(spark):
    full = sinks.publish_table(spark.range(3), "t3_custom", "x")
    sinks.publish_table(spark.range(2).selectExpr("id as `odd name`", "'q' as b"), "t3_custom", "x")
    assert spark.table(full).columns == ["odd name", "b"] and spark.table(full).count() == 2
    sinks.publish_view(spark, "t3_custom", "v", "t3_custom.x", ["`odd name` + 1 as n"])
    assert sorted(r.n for r in spark.table("t3_custom.v").collect()) == [1, 2]
    sinks.publish_table(spark.range(1), "t3_custom", "v")
    assert spark.catalog.getTable("t3_custom.v").tableType != "VIEW"
    sinks.publish_view(spark, "t3_custom", "v", "t3_custom.x", ["b"])
    assert spark.table("t3_custom.v").columns == ["b"]


def test_unknown_described_column(raw):
    with pytest.raises(ValueError, match="lacks"):
        build(Warehouse(raw), ["nba_elo_pre_1976"], "t4_", descriptions={"nba_elo_pre_1976": (None, {"nope": "x"})})


def test_no_constant_null_columns(spark, raw):
    from pyspark.sql import functions as F
    from overmark.sources.specs import STAGING_SPECS
    for m in STAGING_SPECS:
        df = Warehouse(raw).model(m)
        got = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
        assert all(got.values()), (m, [c for c, v in got.items() if not v])


def test_declared_orders(raw):
    w = Warehouse(raw)
    g = w.model("nba_kaggle_games").columns
    assert g[12:17] == ["game_subtype", "series_id", "game_label", "series_game_number", "game_sublabel"]
    e = w.model("nba_kaggle_player_statistics_extended").columns
    assert e[4:10] == ["game_datetime_est", "series_id", "game_type", "game_label", "series_game_number", "game_sub_label"]
    t = w.model("elo_teams_mapping").columns
    assert t[-5:] == ["team_id", "opp_id", "kaggle_team_id", "kaggle_opp_team_id", "kaggle_home_team_id"]
