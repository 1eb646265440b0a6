"""Interval joins by cells and ranked lookups, against brute force and with
broadcasting off; exchange counts of the identity plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from overmark.operators import identity as I
from overmark.operators.intervals import cascade, interval_join, ranked_lookup
from overmark.plans.bindings import Bindings


@pytest.fixture
def no_broadcast(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_interval_join_matches_brute_force(spark, no_broadcast, how):
    rng = random.Random(2)
    points = [(i, rng.choice("abc") if rng.random() < .9 else None, rng.choice([None, *range(-40, 60)])) for i in range(600)]
    spans = []
    for j in range(80):
        lo = rng.choice([None, *range(-45, 60)])
        hi = None if lo is None or rng.random() < .1 else lo + rng.randint(-3, 50)
        spans.append((j, rng.choice(["a", "b", "c", None]), lo, hi))
    want = []
    for i, k, x in points:
        hits = [j for j, h, lo, hi in spans if None not in (k, h, x, lo, hi) and k == h and lo <= x <= hi]
        want += [(i, j) for j in hits] or ([(i, None)] if how == "left" else [])
    left = spark.createDataFrame(points, "i int, k string, x int")
    right = spark.createDataFrame(spans, "j int, h string, lo int, hi int")
    for cell in (1, 8, 100):
        out = interval_join(left, right, [(F.col("k"), "h")], F.col("x"), "lo", "hi", how, cell)
        assert sorted(map(str, out.select("i", "j").collect())) == sorted(f"Row(i={i}, j={j})" for i, j in want)
        assert out.columns == ["i", "k", "x", "j"]
    assert "Broadcast" not in executed(out) and "NestedLoop" not in executed(out)
    assert interval_join(left.limit(0), right, [(F.col("k"), "h")], F.col("x"), "lo", "hi").count() == 0
    assert interval_join(left, right.limit(0), [(F.col("k"), "h")], F.col("x"), "lo", "hi").count() == 600


def test_one_hot_key_does_not_meet_all_its_intervals(spark, no_broadcast):
    """A key with all points and 2,000 short intervals: candidates stay near
    the matches instead of points x intervals."""
    left = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") % 16_000).alias("x"))
    right = spark.range(2_000).select(F.lit("k").alias("h"), F.col("id").alias("j"), (F.col("id") * 8).alias("lo"),
                                      (F.col("id") * 8 + 3).alias("hi"))
    out = interval_join(left, right, [(F.col("k"), "h")], F.col("x"), "lo", "hi")
    assert out.where("j IS NOT NULL").count() == 10_000 and out.count() == 20_000
    text = out._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"hashpartitioning\(([^)]*)\)", text).group(1)
    assert "_ij_cell" in keys


def test_ranked_lookup_and_cascade(spark):
    a = spark.createDataFrame([(1, 5), (1, 3), (2, None), (3, 9)], "k int, v int")
    b = spark.createDataFrame([(1, 0), (2, 7), (2, 6), (4, 1), (None, 2)], "k int, v int")
    got = {r["k"]: r["v"] for r in ranked_lookup([a, b], ["k"], "v").collect()}
    assert got == {1: 3, 2: 6, 3: 9, 4: 1, None: 2}
    rows = spark.createDataFrame([(i, i, "d" if i % 2 else None) for i in range(6)], "i int, k int, d string")
    by_day = spark.createDataFrame([("d", 40), ("d", 30)], "day string, v int")
    out = cascade(rows, [([(F.col("k"), "k")], a, "v"), ([(F.col("d"), "day")], by_day, "v")], "v")
    # k = 2 matches with a NULL value: no later level is asked
    assert {r["i"]: r["v"] for r in out.collect()} == {0: None, 1: 3, 2: None, 3: 9, 4: None, 5: 30}
    assert out.columns == ["i", "k", "d", "v"]


def _games(b):
    k = F.col("game_id")
    return b.game_code.select("game_id", F.col("season").alias("year_id"), F.col("team_code").alias("elo_team_abbrev_raw"),
                              F.concat(F.lit("t"), (k % 4).cast("string")).alias("elo_opp_abbrev_raw"))


def test_overrides_join_the_games_once_a_side(spark, no_broadcast, tmp_path):
    b = Bindings(spark, SF_SMALL)
    _games(b).write.parquet(str(tmp_path / "games"))
    games = spark.read.parquet(str(tmp_path / "games"))
    teams = spark.createDataFrame([("T0", 1994, 1000), ("T1", 1994, 1001), ("T1", 1994, None)],
                                  "team_abbrev string, year_id bigint, kaggle_team_id bigint")
    over = spark.createDataFrame([("T1", 1994, 77)], "abbrev string, year_id bigint, team_id bigint")
    out = I.resolve_team_override(games, teams, over)
    text = executed(out)
    assert text.count("FileScan") == 1 and text.count("SortMergeJoin") == 2
    # the games move once a side; what else moves is the lookup (two folds, read by both sides)
    games_moved = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", text) if "raw" in x or "year_id" in x]
    assert out.count() == games.where("year_id >= 1977").count() and len(games_moved) <= 4
    ids = {(r["elo_opp_abbrev_raw"], r["kaggle_opp_team_id"]) for r in out.where("year_id = 1994").collect()}
    assert {("t0", 1000), ("t1", 77)} >= {x for x in ids if x[0] in ("t0", "t1")}


def test_identity_operators_need_no_broadcast(spark, no_broadcast):
    b = Bindings(spark, SF_SMALL)
    c = b.game_code
    games = c.select("game_id", F.col("season").alias("year_id"), F.col("team_code").alias("team_id"),
                     F.col("fran").alias("fran_id"), F.lit("t1").alias("opp_id"), F.lit("Club 1").alias("opp_fran"),
                     F.lit("H").alias("game_location"))
    out = I.resolve_team_validity(games, b.team_hist)
    text = executed(out)
    assert "Broadcast" not in text and "Cartesian" not in text and "NestedLoop" not in text
    h = {}
    for r in b.team_hist.collect():
        h.setdefault(r["team_abbrev"], []).append(r)
        h.setdefault(r["team_name"], []).append(r)

    def find(key, year):
        return next((r["team_id"] for r in h.get(key, []) if r["season_founded"] <= year <= (r["season_active_till"] or 2100)), None)

    for r in out.collect():
        want = find(r["team_id"].strip().upper(), r["year_id"]) or find(r["fran_id"].strip().upper(), r["year_id"])
        assert r["kaggle_team_id"] == want == r["kaggle_home_team_id"]
    assert out.count() == games.count()
