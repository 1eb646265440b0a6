"""One small literal frame per semantic trap."""

import datetime as dt

from pyspark.sql import functions as F

from overmark.functions import odds, safe


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_safe_cast_int_rejects_decimal_text(spark):
    assert one(spark, safe.safe_cast("x", "bigint"), "12.0", "x string") is None
    assert one(spark, safe.safe_cast("x", "bigint"), " 12 ", "x string") == 12
    assert one(spark, safe.safe_cast("x", "bigint"), "N/A", "x string") is None


def test_round_cast_half_away_from_zero(spark):
    assert one(spark, safe.round_cast("x"), "12.5", "x string") == 13
    assert one(spark, safe.round_cast("x"), "-2.5", "x string") == -3
    assert one(spark, safe.round_cast("x", strip_plus=True), "+7", "x string") == 7
    assert one(spark, safe.round_cast("x"), "", "x string") is None


def test_safe_bool_only_true_false(spark):
    assert one(spark, safe.safe_bool("x"), "TRUE", "x string") is True
    assert one(spark, safe.safe_bool("x"), "false", "x string") is False
    assert one(spark, safe.safe_bool("x"), "yes", "x string") is None
    assert one(spark, safe.safe_bool("x"), "1", "x string") is None


def test_parse_date_strict(spark):
    assert one(spark, safe.parse_date("x"), "2020-01-05", "x string") == dt.date(2020, 1, 5)
    assert one(spark, safe.parse_date("x"), "2020-1-5", "x string") is None
    assert one(spark, safe.parse_date("x"), "2020", "x string") is None


def test_safe_divide_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(safe.safe_divide("a", "b").alias("r")).first()["r"] is None


def test_least_greatest_propagate_null(spark):
    df = spark.createDataFrame([(1, None), (3, 2)], "a bigint, b bigint")
    rows = df.select(safe.least_nn("a", "b").alias("lo"), safe.greatest_nn("a", "b").alias("hi")).collect()
    assert (rows[0]["lo"], rows[0]["hi"]) == (None, None)
    assert (rows[1]["lo"], rows[1]["hi"]) == (2, 3)


def test_slice_and_offset_are_zero_based(spark):
    df = spark.createDataFrame([("New Orleans/Oklahoma City Hornets",)], "x string")
    parts = F.split("x", " ")
    r = df.select(safe.element0(parts, 0).alias("a"), safe.element0(parts, 9).alias("b"),
                  F.array_join(safe.slice0(parts, 3), " ").alias("c"),
                  F.array_join(safe.slice0(parts, 9), " ").alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("New", None, "Hornets", "")


def test_concat_null_propagates_into_slug(spark):
    df = spark.createDataFrame([("2001", None), ("2001", "West - First Round")], "y string, l string")
    rows = df.select(safe.slug(F.concat("y", "l")).alias("s")).collect()
    assert rows[0]["s"] is None and rows[1]["s"] == "2001westfirstround"


def test_extract_digits_whole_match_or_null(spark):
    assert one(spark, safe.extract_digits("x"), "Game 12", "x string") == 12
    assert one(spark, safe.extract_digits("x"), "Final", "x string") is None
    assert one(spark, safe.extract_digits("x"), None, "x string") is None


def test_null_sentinel_and_label_cleanup(spark):
    assert one(spark, safe.null_if_sentinel("x"), "N/A", "x string") is None
    assert one(spark, safe.null_if_sentinel("x"), "-150", "x string") == -150.0
    assert one(spark, safe.label_cleanup("x"), "East - First Round", "x string") == "East First Round"
    assert one(spark, safe.label_cleanup("x"), None, "x string") is None


def test_game_number_fix_maps_any_one(spark):
    df = spark.createDataFrame([("10",), ("4",), (None,)], "x string")
    assert [r["r"] for r in df.select(safe.game_number_fix("x").alias("r")).collect()] == [1.0, 4.0, None]


def test_three_zero_price_conventions(spark):
    df = spark.createDataFrame([(0.0,), (-150.0,), (150.0,), (None,)], "p double")
    rows = df.select(odds.implied_prob("p", "one").alias("a"), odds.implied_prob("p", "zero").alias("b"),
                     odds.implied_prob("p", "null").alias("c")).collect()
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"]) == (1.0, 0.0, None)
    assert abs(rows[1]["a"] - 0.6) < 1e-12 and abs(rows[1]["b"] - 0.6) < 1e-12 and abs(rows[1]["c"] - 0.6) < 1e-12
    assert abs(rows[2]["a"] - 0.4) < 1e-12
    assert rows[3]["a"] is None and rows[3]["b"] is None and rows[3]["c"] is None


def test_american_price_grid_and_bounds(spark):
    df = spark.createDataFrame([(0.6,), (0.4,), (0.0,), (1.0,), (None,), (0.5,)], "p double")
    got = [r["m"] for r in df.select(odds.american_price("p").alias("m")).collect()]
    assert got == [-150.0, 150.0, None, None, None, -100.0]


def test_price_probability_round_trip_within_grid(spark):
    ps = [(i / 100.0,) for i in range(5, 96)]
    df = spark.createDataFrame(ps, "p double")
    m = df.select("p", odds.american_price("p").alias("m"))
    back = m.select("p", "m", odds.implied_prob("m", "one").alias("q")).collect()
    for r in back:
        assert r["m"] % 5 == 0
        assert abs(r["q"] - r["p"]) < 0.02
