"""Entity identity resolution across sources (D-11 … D-15).

Dimension tables here (team histories, per-season team tables, override
rows) are bounded by the number of franchises × seasons, so they are
broadcast when their size estimate allows; the large side (games) is never
shuffled for these joins.  Validity intervals are equality on a code plus a
range residual, which a broadcast hash join evaluates per matching pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import ColumnOrName, _c, element0, slice0
from .intervals import interval_join, ranked_lookup

# City / nickname parsing rules for full team names.
# Exact full names with an irregular split: name → (city, nickname); a None
# city falls through to the prefix rules / first word.
EXACT_NAMES = {
    "Spirits of St. Louis": ("St. Louis", "Spirits"),
    "Portland Trail Blazers": (None, "Trail Blazers"),
    "Providence Steam Rollers": (None, "Steam Rollers"),
    "Sheboygan Red Skins": (None, "Red Skins"),
}
# Multi-word city prefixes (tested in this order), each followed by a space.
CITY_PREFIXES = [
    "Fort Wayne", "Golden State", "Kansas City-Omaha", "Kansas City", "Los Angeles",
    "New Jersey", "New Orleans/Oklahoma City", "New Orleans", "New York", "Oklahoma City",
    "San Antonio", "San Diego", "San Francisco", "St. Louis",
]
# Nickname = words from this 0-based position on, per prefix.  A prefix that
# is not listed here (Kansas City-Omaha) falls through to the default (1).
NAME_START = {
    "Fort Wayne": 2, "Golden State": 2, "Kansas City": 2, "Los Angeles": 2, "New Jersey": 2,
    "New Orleans/Oklahoma City": 3, "New Orleans": 2, "New York": 2, "Oklahoma City": 2,
    "San Antonio": 2, "San Diego": 2, "San Francisco": 2, "St. Louis": 2,
}

# Manual team-id overrides by (abbreviation, season).
MANUAL_TEAM_IDS = [
    ("CHA", (2010, 2014, 2016), 1610612766),
    ("NJN", (2013, 2014, 2015, 2019, 2020, 2021, 2022, 2023), 1610612751),
    ("NOH", (1993, 1995, 1997, 1998, 2000, 2001, 2002), 1610612766),
    ("NOH", (2003, 2004, 2008, 2009, 2011, 2015, 2018, 2022, 2024), 1610612740),
    ("OKC", (1978, 1979, 1980, 1982, 1983, 1984, 1987, 1988, 1989, 1991, 1992, 1993, 1994,
             1995, 1996, 1997, 1998, 2000, 2002, 2005), 1610612760),
    ("SAC", (1979, 1980, 1981, 1984), 1610612758),
    ("WAS", (1977, 1978, 1979, 1980, 1982, 1984, 1985, 1986, 1987, 1988, 1997), 1610612764),
]
# A full name whose team id is pinned regardless of history.
PINNED_TEAM_IDS = {"New Orleans/Oklahoma City Hornets": 1610612740}


def parse_team_name(full: ColumnOrName) -> tuple[Column, Column]:
    """Full team name → (city, nickname) Columns by the rule tables."""
    f = _c(full)
    parts = F.split(f, " ", -1)
    city = None
    name = None
    for exact, (c, n) in EXACT_NAMES.items():
        if c is not None:
            city = F.when(f == exact, F.lit(c)) if city is None else city.when(f == exact, F.lit(c))
        name = F.when(f == exact, F.lit(n)) if name is None else name.when(f == exact, F.lit(n))
    for p in CITY_PREFIXES:
        city = city.when(f.like(p + " %"), F.lit(p))
    for p, start in NAME_START.items():
        name = name.when(f.like(p + " %"), F.array_join(slice0(parts, start), " "))
    city = city.otherwise(element0(parts, 0))
    name = name.otherwise(F.array_join(slice0(parts, 1), " "))
    return city, name


def manual_overrides(spark, rows=MANUAL_TEAM_IDS) -> DataFrame:
    """Override table as rows (abbrev, year_id, team_id) — data, not CASE."""
    flat = [(a, y, t) for a, years, t in rows for y in years]
    return spark.createDataFrame(flat, "abbrev string, year_id bigint, team_id bigint")


def match_team_season(teams: DataFrame, histories: DataFrame, name_col="full_team_name",
                      year_col="year", abbrev_col="team_abbrev", year_lag: int = 1,
                      pinned: dict | None = None) -> DataFrame:
    """D-15: team-season → team id.

    Match on city and nickname (parsed from the full name, trimmed, case
    folded) with the *previous* season inside the history's validity
    interval (a NULL end never matches here).  Among matches prefer the one
    whose abbreviation equals the team's, then the latest founding season.
    ``pinned`` full names get a constant id.
    """
    pinned = PINNED_TEAM_IDS if pinned is None else pinned
    city, nick = parse_team_name(name_col)
    t = teams.withColumns({"team_city": city, "team_name": nick})
    h = histories.select(F.col("team_id").alias("_h_id"),
                         F.lower(F.trim("team_city")).alias("_h_city"),
                         F.lower(F.trim("team_name")).alias("_h_name"),
                         F.trim("team_abbrev").alias("_h_abbr"), F.col("season_founded").alias("_h_founded"),
                         F.col("season_founded").alias("_h_from"),
                         F.col("season_active_till").alias("_h_till"))
    j = interval_join(t, h, [(F.lower(F.trim("team_city")), "_h_city"), (F.lower(F.trim("team_name")), "_h_name")],
                      F.col(year_col) - year_lag, "_h_from", "_h_till")
    # First match per team-season: a two-key priority min.  The group is one
    # team-season (a handful of candidate rows), so this is a tiny aggregate.
    prio = F.when(F.trim(F.col(abbrev_col)) == F.col("_h_abbr"), 0).otherwise(1)
    keys = [name_col, year_col, abbrev_col]
    rest = [c for c in t.columns if c not in keys]
    best = (j.groupBy(*keys)
            .agg(F.min_by(F.struct("_h_id", *[F.col(c) for c in rest]),
                          F.struct(prio.alias("p"), (-F.col("_h_founded")).alias("f"))).alias("_b")))
    out = best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest], F.col("_b._h_id").alias("_id"))
    pin = None
    for full, tid in pinned.items():
        pin = (F.when(F.col(name_col) == full, F.lit(tid)) if pin is None
               else pin.when(F.col(name_col) == full, F.lit(tid)))
    team_id = pin.otherwise(F.col("_id")) if pin is not None else F.col("_id")
    return out.select(team_id.cast("bigint").alias("team_id"), *t.columns)


def resolve_team_validity(games: DataFrame, histories: DataFrame,
                          sides=(("team_id", "fran_id", "kaggle_team_id"),
                                 ("opp_id", "opp_fran", "kaggle_opp_team_id")),
                          year_col: str = "year_id", location_col: str = "game_location",
                          open_end: int | None = 2100, min_end: int = 1970,
                          fran_aliases: dict | None = None) -> DataFrame:
    """D-12: per side, match the abbreviation inside the validity interval;
    where that misses, match the franchise name inside the interval.  The
    home id follows the location flag ('H' → first side, 'A' → second).

    A NULL interval end is open (``open_end``) unless ``open_end`` is None.
    Overlapping intervals fan out, as a plain left join does.

    Only the distinct (code, name, year) of both sides are matched with the
    intervals; the games are joined with the outcome, once a side.
    """
    till = F.col("season_active_till")
    if open_end is not None:
        till = F.coalesce(till, F.lit(open_end))
    hist = (histories.select(F.col("team_id").alias("_h_id"),
                             F.upper(F.trim("team_abbrev")).alias("_h_abbr"),
                             F.upper(F.trim("team_name")).alias("_h_name"),
                             F.col("season_founded").alias("_h_from"), till.alias("_h_till"))
            .where(F.col("_h_till") >= min_end))
    year = F.col(year_col).try_cast("bigint")
    names = ["_r_code", "_r_fran", "_r_year"]

    def asked(code_col, fran_col):
        fran = F.upper(F.trim(fran_col))
        for k, (v, before) in (fran_aliases or {}).items():
            fran = F.when((fran == k) & (year < before), F.lit(v)).otherwise(fran)
        return [F.upper(F.trim(code_col)), fran, year]

    known = None
    for code_col, fran_col, _ in sides:
        one = games.select(*[e.alias(n) for n, e in zip(names, asked(code_col, fran_col), strict=True)]).distinct()
        known = one if known is None else known.union(one)
    known = known.distinct()
    span = ["_h_from", "_h_till"]
    known = interval_join(known, hist.select("_h_abbr", *span, F.col("_h_id").alias("_r_a")),
                          [(F.col("_r_code"), "_h_abbr")], F.col("_r_year"), *span)
    known = interval_join(known, hist.select("_h_name", *span, F.col("_h_id").alias("_r_f")),
                          [(F.col("_r_fran"), "_h_name")], F.when(F.col("_r_a").isNull(), F.col("_r_year")), *span)
    known = known.select(*names, F.coalesce("_r_a", "_r_f").alias("_r_id"))
    df = games
    for code_col, fran_col, out in sides:
        side = known.select(*[F.col(n).alias(f"{n}_s") for n in names], F.col("_r_id").alias(out))
        cond = F.lit(True)
        for n, e in zip(names, asked(code_col, fran_col), strict=True):
            cond = cond & e.eqNullSafe(F.col(f"{n}_s"))
        df = df.join(side, cond, "left").drop(*[f"{n}_s" for n in names])
    first, second = sides[0][2], sides[1][2] if len(sides) > 1 else None
    home = F.when(F.col(location_col) == "H", F.col(first))
    if second:
        home = home.when(F.col(location_col) == "A", F.col(second))
    return df.withColumn("kaggle_home_team_id", home)


def resolve_team_override(games: DataFrame, teams: DataFrame, overrides: DataFrame,
                          sides=(("elo_team_abbrev_raw", "kaggle_team_id"),
                                 ("elo_opp_abbrev_raw", "kaggle_opp_team_id")),
                          year_col: str = "year_id", min_year: int | None = 1977) -> DataFrame:
    """D-11: per side, the season's team table matched on year and trimmed,
    upper-cased abbreviation; else the manual override for (abbrev, year).
    Of several matches the smallest id counts, NULL first: a team row
    without an id leaves the choice to the override.  The home id is the
    first side's (these games are home-team rows).

    Team table and overrides are folded to one row a (year, code) first;
    games before ``min_year`` go before the joins, and the rest are joined
    with that unique table once a side.
    """
    t = teams.select(F.col("year_id").alias("_l_year"), F.upper(F.trim("team_abbrev")).alias("_l_code"),
                     F.col("kaggle_team_id").alias("_l_id"))
    gap = t.groupBy("_l_year", "_l_code").agg(F.when(F.count(F.lit(1)) == F.count("_l_id"), F.min("_l_id")).alias("_l_id"))
    o = overrides.select(F.col("year_id").alias("_l_year"), F.col("abbrev").alias("_l_code"),
                         F.col("team_id").alias("_l_id"))
    ids = ranked_lookup([gap, o], ["_l_year", "_l_code"], "_l_id")
    df = games if min_year is None else games.where(F.col(year_col) >= min_year)
    for raw, out in sides:
        side = ids.withColumnRenamed("_l_id", out)
        df = df.join(side, (F.col(year_col) == F.col("_l_year")) & (F.upper(F.trim(raw)) == F.col("_l_code")),
                     "left").drop("_l_year", "_l_code")
    return df.withColumn("kaggle_home_team_id", F.col(sides[0][1]))


def backfill_team_id(stats: DataFrame, histories: DataFrame,
                     sides=(("player_team_id_raw", "player_team_city", "player_team_name",
                             "player_team_id"),
                            ("opponent_team_id_raw", "opponent_team_city", "opponent_team_name",
                             "opponent_team_id")),
                     ts_col: str = "game_date_time_est") -> DataFrame:
    """D-13: keep the raw id; only where it is NULL, look the team up by
    city + name with the game's year inside the validity interval.  Rows
    with an id are not matched and never dropped."""
    df = stats
    for raw, city, name, out in sides:
        h = histories.select(F.col("team_id").alias("_h_id"),
                             F.lower(F.trim("team_city")).alias("_h_city"),
                             F.lower(F.trim("team_name")).alias("_h_name"),
                             F.col("season_founded").alias("_h_from"),
                             F.col("season_active_till").alias("_h_till"))
        asked = F.when(F.col(raw).isNull(), F.year(F.col(ts_col)))
        df = interval_join(df, h, [(F.lower(F.trim(city)), "_h_city"), (F.lower(F.trim(name)), "_h_name")],
                           asked, "_h_from", "_h_till")
        df = df.withColumn(out, F.coalesce(F.col(raw), F.col("_h_id"))).drop("_h_id")
    return df
