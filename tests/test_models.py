"""Every warehouse model builds by name from string-first raw tables."""

import pytest
from pyspark.sql import types as T

from overmark.plans.models import BUILDERS, ELO_TEAM_SPEC, Warehouse
from overmark.sources import conform as cf
from overmark.sources.catalog import Catalog
from overmark.sources.specs import STAGING_SPECS

EXTRA_RAW = {
    "nba_odds_raw.nba_games_all": "game_id game_date matchup team_id pts wl season_year season_type season is_home",
    "nba_elo.nba_elo_teams_all_time": " ".join(t.split(">")[0].split(":")[0] for t in ELO_TEAM_SPEC.split()),
}


@pytest.fixture(scope="module")
def warehouse(spark):
    cat = Catalog(spark)
    raw_cols = {}
    for model, (source, _) in STAGING_SPECS.items():
        raw_cols.setdefault(source, []).extend(f.name for f in cf.raw_string_schema(model).fields)
    for source, cols in EXTRA_RAW.items():
        raw_cols[source] = cols.split()
    for source, cols in raw_cols.items():
        cols = list(dict.fromkeys(cols))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        name = "raw_" + source.replace(".", "_")
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
        cat.entries[source] = None
        cat.register(source, name, fmt="__view__")
    # views resolve through the session catalog
    cat.scan = lambda s, _c=cat: spark.table("raw_" + s.replace(".", "_"))
    return Warehouse(cat)


def test_48_models(warehouse):
    assert len(BUILDERS) == 48


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_model_resolves(warehouse, name):
    df = warehouse.model(name)
    assert len(df.columns) > 0
    assert len(set(df.columns)) == len(df.columns), name


def test_curated_columns(warehouse):
    g = warehouse.model("nba_kaggle_games")
    assert "series_id" in g.columns and dict(g.dtypes)["series_game_number"] == "double"
    assert "game_datetime_est" in warehouse.model("nba_kaggle_play_by_play").columns
    assert dict(warehouse.model("stg_nba_kaggle_play_by_play").dtypes)["qualifiers"] == \
        "array<struct<element:string>>"
    assert warehouse.model("elo_series_mapping").count() == 0
