"""Declarative conform, landing and name normalisation."""

from pyspark.sql import types as T

from overmark.session import scratch_path
from overmark.sources import conform as cf
from overmark.sources.specs import STAGING_SPECS


def test_every_spec_parses_and_names_are_unique():
    for model, (_, spec) in STAGING_SPECS.items():
        rules = cf.parse_spec(spec)
        names = [r.name for r in rules]
        assert len(names) == len(set(names)), model
    assert len(cf.staging_rules("stg_nba_kaggle_player_statistics")) == 40
    assert len(cf.staging_rules("stg_nba_kaggle_team_statistics_extended")) == 100


def test_normalize_name():
    assert cf.normalize_name("Home/Away-Odds (%)") == "home_away_odds"
    assert cf.normalize_name("  Priority / Level ") == "priority_level"


def test_string_first_landing_and_conform(spark):
    path = scratch_path(spark, "landing_test")
    rows = [("1.0", "12.5", "+3", "2020-01-05", "true"), ("x", "N/A", "", "2020-1-5", "yes")]
    spark.createDataFrame(rows, "a string, b string, c string, d string, e string") \
        .write.mode("overwrite").option("header", True).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abcde"])
    landed = cf.land_strings(spark, path, schema)
    out = cf.conform(landed, "a>a_int:i b>b_round:ir c>c_plus:ir+ d>d_date:dp e>e_bool:b")
    got = sorted([tuple(r) for r in out.collect()], key=str)
    import datetime as dt
    assert (None, 13, 3, dt.date(2020, 1, 5), True) in got
    assert (None, None, None, None, None) in got
    assert [f.dataType for f in out.schema.fields] == [T.LongType(), T.LongType(), T.LongType(), T.DateType(),
                                                        T.BooleanType()]


def test_missing_raw_columns_raise_unless_optional(spark):
    import pytest

    df = spark.createDataFrame([("7",)], "gameId string")
    with pytest.raises(ValueError, match="gameDateTimeEst"):
        cf.conform_model(df, "stg_nba_kaggle_games")
    rest = tuple(r.raw for r in cf.staging_rules("stg_nba_kaggle_games") if r.raw != "gameId")
    out = cf.conform_model(df, "stg_nba_kaggle_games", optional=rest)
    assert len(out.columns) == 23 and out.first()["game_id"] == 7


def test_save_table_routes_schema_and_persists_docs(spark):
    from overmark.sources.sinks import save_table
    df = spark.createDataFrame([(1, "a")], "game_id bigint, label string")
    full = save_table(df, "games_doc", database="kaggle", comment="one row per game",
                      column_comments={"game_id": "game key"})
    assert full == "kaggle.games_doc"
    meta = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()}
    assert meta.get("Comment") == "one row per game"
    cols = {r["col_name"]: r["comment"] for r in spark.sql(f"DESCRIBE TABLE {full}").collect()}
    assert cols["game_id"] == "game key"
    assert spark.table(full).count() == 1


def test_csv_binds_by_header_and_missing_raises(spark):
    import pytest

    from overmark.session import scratch_path
    path = scratch_path(spark, "shuffled_csv")
    spark.createDataFrame([("7", "x", "2020")], "c string, a string, b string").coalesce(1).write.option("header", True).csv(path)
    schema = cf.T.StructType([cf.T.StructField(n, cf.T.StringType()) for n in "abc"])
    assert tuple(cf.land_strings(spark, path, schema).first()) == ("x", "2020", "7")
    with pytest.raises(ValueError, match="missing"):
        cf.land_strings(spark, path, cf.T.StructType([cf.T.StructField("z", cf.T.StringType())]))
    with pytest.raises(ValueError, match="missing"):
        cf.conform(spark.range(1), "id>id:i gone>gone:i")
    assert cf.conform(spark.range(1), "id>id:i gone>gone:i", optional=("gone",)).first()["gone"] is None


def test_play_by_play_lands_every_column_by_name(spark):
    from overmark.session import scratch_path
    model = "stg_nba_kaggle_play_by_play"
    names = [f.name for f in cf.raw_string_schema(model).fields]
    rules = {r.raw: r for r in cf.staging_rules(model)}
    cell = lambda i, n: "[]" if rules[n].kind == "a" else str(i)
    cells = {n: ('{"list":[{"element":"q1"}]}' if rules[n].kind == "a" else cell(i, n)) for i, n in enumerate(names)}
    path = scratch_path(spark, "pbp_csv")
    spark.createDataFrame([tuple(cells[n] for n in reversed(names))], ", ".join(f"`{n}` string" for n in reversed(names))) \
        .write.option("header", True).option("escape", '"').csv(path)
    landed = cf.land_strings(spark, path, cf.raw_string_schema(model))
    out = cf.conform(landed, list(rules.values())).first()
    for i, n in enumerate(names):
        r = rules[n]
        if r.kind == "s":
            assert out[r.name] == str(i), n
        if r.kind == "i":
            assert out[r.name] == i, n
