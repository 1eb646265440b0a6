"""Series probability: distribution fold vs literal path enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from overmark.functions import series as S

SCHEDULES = {
    (1980, "East - First Round"): (2, "HAH"),
    (1990, "West - First Round"): (3, "HHAAH"),
    (1990, "Finals"): (4, "HHAAAHH"),
    (2015, "West - Conf. Semis"): (4, "HHAAHAH"),
}


def brute(p, home, schedule, need):
    """Enumerate every path and add the ones the side clinches first."""
    probs = []
    for loc in schedule:
        own = (loc == "H" and home == 1) or (loc == "A" and home == 0)
        probs.append(p if own else 1 - p)
    total = 0.0
    for bits in itertools.product([0, 1], repeat=len(probs)):
        w = l = 0
        first = None
        pr = 1.0
        for b, q in zip(bits, probs):
            pr *= q if b else 1 - q
            w += b
            l += 1 - b
            if first is None and w == need:
                first = "p"
            if first is None and l == need:
                first = "o"
        if first == "p":
            total += pr
    return total


def test_formats_by_era(spark):
    rows = [(y, lab) for (y, lab) in SCHEDULES]
    df = spark.createDataFrame(rows, "y bigint, l string")
    out = df.select("y", "l", S.series_required_wins("y", "l").alias("n"),
                    F.array_join(S.series_schedule("y", "l"), "").alias("s")).collect()
    for r in out:
        assert (r["n"], r["s"]) == SCHEDULES[(r["y"], r["l"])]


@pytest.mark.parametrize("home", [0, 1])
def test_fold_equals_enumeration(spark, home):
    random.seed(7)
    rows = []
    for (y, lab), (need, sched) in SCHEDULES.items():
        for _ in range(5):
            rows.append((y, lab, random.random(), home))
        rows.append((y, lab, 0.63, home))
        rows.append((y, lab, 1.0, home))
        rows.append((y, lab, 0.0, home))
    df = spark.createDataFrame(rows, "y bigint, l string, p double, h bigint")
    f = S.series_forecast(S.series_schedule("y", "l"), "p", "h", S.series_required_wins("y", "l"))
    for r in df.select("y", "l", "p", "h", f.alias("sf")).collect():
        need, sched = SCHEDULES[(r["y"], r["l"])]
        assert abs(r["sf"] - brute(r["p"], r["h"], sched, need)) < 1e-12


def test_published_values_at_063(spark):
    expected = {"HAH": 0.569394, "HHAAH": 0.551170, "HHAAAHH": 0.542397, "HHAAHAH": 0.542397}
    rows = [(y, lab, 0.63, 1) for (y, lab) in SCHEDULES]
    df = spark.createDataFrame(rows, "y bigint, l string, p double, h bigint")
    f = S.series_forecast(S.series_schedule("y", "l"), "p", "h", S.series_required_wins("y", "l"))
    for r in df.select("y", "l", F.array_join(S.series_schedule("y", "l"), "").alias("s"), f.alias("sf")).collect():
        assert round(r["sf"], 6) == expected[r["s"]]


def test_unknown_forecast_gives_zero(spark):
    df = spark.createDataFrame([(2015, "Finals", None, 1), (2015, "Finals", 0.6, None)],
                               "y bigint, l string, p double, h bigint")
    f = S.series_forecast(S.series_schedule("y", "l"), "p", "h", S.series_required_wins("y", "l"))
    assert [r["sf"] for r in df.select(f.alias("sf")).collect()] == [0.0, 0.0]


def test_faithful_venue_is_not_mirrored_but_option_is(spark):
    rows = [(1990, "Finals", 0.7, 1), (1990, "Finals", 0.3, 0)]
    df = spark.createDataFrame(rows, "y bigint, l string, p double, h bigint")
    sched, need = S.series_schedule("y", "l"), S.series_required_wins("y", "l")
    faithful = [r["f"] for r in df.select(S.series_forecast(sched, "p", "h", need).alias("f")).collect()]
    mirrored = [r["f"] for r in df.select(S.series_forecast(sched, "p", "h", need, True).alias("f")).collect()]
    assert abs(faithful[0] - faithful[1]) < 1e-12          # both sides get the same number
    assert abs(mirrored[0] + mirrored[1] - 1.0) < 1e-12    # mirrored odds sum to one


def test_enumerated_operator_matches_fold(spark):
    from overmark.operators import series_ops as SO
    rows = [("s1", 1, 2, 1990, "Finals", 0.61, 1, None),
            ("s2", 1, 2, 1980, "East - First Round", 0.45, 0, None),
            ("s3", 3, 4, 2010, "West - Conf. Semis", None, 1, None)]
    df = spark.createDataFrame(rows, "series_id string, player_team_id bigint, opponent_team_id bigint, "
                                     "year_id bigint, game_label string, player_game_forecast double, "
                                     "player_home bigint, series_start_ts timestamp")
    a = {r["series_id"]: r["series_forecast"] for r in SO.series_odds(df).collect()}
    b = {r["series_id"]: r["series_forecast"] for r in SO.series_odds_enumerated(df).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k] - b[k]) < 1e-12
    assert a["s3"] == 0.0
