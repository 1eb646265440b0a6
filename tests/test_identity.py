"""Identity-resolution rules."""

from overmark.operators import identity as I
from overmark.plans.bindings import TEAM_NAMES, Bindings

from conftest import SF_CHECK

EXPECTED = {
    "Spirits of St. Louis": ("St. Louis", "Spirits"),
    "Fort Wayne Pistons": ("Fort Wayne", "Pistons"),
    "Golden State Warriors": ("Golden State", "Warriors"),
    "Kansas City-Omaha Kings": ("Kansas City-Omaha", "City-Omaha Kings"),
    "Kansas City Kings": ("Kansas City", "Kings"),
    "Los Angeles Lakers": ("Los Angeles", "Lakers"),
    "New Jersey Nets": ("New Jersey", "Nets"),
    "New Orleans/Oklahoma City Hornets": ("New Orleans/Oklahoma City", "Hornets"),
    "New Orleans Jazz": ("New Orleans", "Jazz"),
    "New York Knicks": ("New York", "Knicks"),
    "Oklahoma City Thunder": ("Oklahoma City", "Thunder"),
    "San Antonio Spurs": ("San Antonio", "Spurs"),
    "San Diego Clippers": ("San Diego", "Clippers"),
    "San Francisco Warriors": ("San Francisco", "Warriors"),
    "St. Louis Hawks": ("St. Louis", "Hawks"),
    "Portland Trail Blazers": ("Portland", "Trail Blazers"),
    "Providence Steam Rollers": ("Providence", "Steam Rollers"),
    "Sheboygan Red Skins": ("Sheboygan", "Red Skins"),
    "Boston Celtics": ("Boston", "Celtics"),
}


def test_parse_team_name_rules(spark):
    df = spark.createDataFrame([(n,) for n in TEAM_NAMES], "full string")
    city, name = I.parse_team_name("full")
    got = {r["full"]: (r["c"], r["n"]) for r in df.select("full", city.alias("c"), name.alias("n")).collect()}
    assert got == EXPECTED


def test_validity_match_counts(spark):
    """Open interval end = 2100 vs NULL never matching (two conventions)."""
    from pyspark.sql import functions as F
    b = Bindings(spark, SF_CHECK)
    g = b.game_code
    h = b.team_hist

    def matched(open_end):
        till = F.coalesce("season_active_till", F.lit(2100)) if open_end else F.col("season_active_till")
        hh = h.select("team_id", F.upper("team_abbrev").alias("a"), "season_founded", till.alias("t"))
        j = g.join(hh, (F.upper(F.trim("team_code")) == F.col("a"))
                   & F.col("season").between(F.col("season_founded"), F.col("t")), "left")
        assert j.count() == g.count()      # no fan-out
        return j.where(F.col("team_id").isNotNull()).count()

    assert matched(True) == 9758
    assert matched(False) == 3950


def test_override_rows_are_data(spark):
    o = I.manual_overrides(spark)
    assert o.count() == sum(len(y) for _, y, _ in I.MANUAL_TEAM_IDS)
    assert o.groupBy("abbrev", "year_id").count().where("count > 1").count() == 0
