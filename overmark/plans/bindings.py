"""Domain views over the driver's test tables (TPC-H-shaped parquet).

Each binding is a lazy DataFrame derived from the given tables, so every
query's work grows with the scale factor.  The shapes are those the domain
operators expect (games with a home-win forecast, bookmaker quotes, player
box-score lines, dirty strings, team validity intervals, codes to resolve,
series odds with sentinels).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, test_catalog

# The round labels assigned by order priority.
PRIORITY_LABELS = [
    ("1-URGENT", "East - First Round"),
    ("2-HIGH", "West - First Round"),
    ("3-MEDIUM", "East - Conf. Finals"),
    ("4-NOT SPECIFIED", "West - Conf. Semis"),
]

# One full team name per city/nickname parsing rule.
TEAM_NAMES = [
    "Spirits of St. Louis", "Fort Wayne Pistons", "Golden State Warriors",
    "Kansas City-Omaha Kings", "Kansas City Kings", "Los Angeles Lakers",
    "New Jersey Nets", "New Orleans/Oklahoma City Hornets", "New Orleans Jazz",
    "New York Knicks", "Oklahoma City Thunder", "San Antonio Spurs", "San Diego Clippers",
    "San Francisco Warriors", "St. Louis Hawks", "Portland Trail Blazers",
    "Providence Steam Rollers", "Sheboygan Red Skins", "Boston Celtics",
]


def _label(priority):
    expr = None
    for k, v in PRIORITY_LABELS:
        expr = F.when(priority == k, F.lit(v)) if expr is None else expr.when(priority == k, F.lit(v))
    return expr


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.cat: Catalog = test_catalog(spark, sf_dir)

    def t(self, name: str) -> DataFrame:
        return self.cat.scan(name)

    # -- game: one row per order -------------------------------------------------
    @cached_property
    def game(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        c = self.t("customer").select("c_custkey", "c_nationkey")
        k = F.col("o_orderkey")
        return (o.join(c, o.o_custkey == c.c_custkey, "inner")
                .select(
                    k.alias("game_id"),
                    F.col("o_orderdate").cast("date").alias("game_date"),
                    F.col("o_orderdate").cast("timestamp").alias("game_ts"),
                    (F.year("o_orderdate").cast("bigint")
                     + F.when(F.col("o_custkey") % 3 == 0, -18)
                        .when(F.col("o_custkey") % 3 == 1, 0).otherwise(18)).alias("season"),
                    (F.col("c_nationkey") % 4).cast("bigint").alias("home_team"),
                    ((F.col("c_nationkey") + 1 + k % 3) % 4).cast("bigint").alias("away_team"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "Regular Season")
                     .otherwise("Playoffs").alias("game_type"),
                    _label(F.col("o_orderpriority")).alias("game_label"),
                    F.when(k % 97 == 0, F.lit(None).cast("double"))
                     .when(k % 101 == 0, F.lit(1.0))
                     .otherwise((F.lit(1) + (k * 7919) % 998).cast("double") / F.lit(1000.0))
                     .alias("forecast"),
                    F.when((k * 31) % 100 < 60, "W").otherwise("L").alias("game_result"),
                    F.concat(F.lit("Game "), (k % 7 + 1).cast("string")).alias("series_game_number_raw"),
                    F.col("c_nationkey").alias("nation_key"),
                ))

    @cached_property
    def game_first(self) -> DataFrame:
        """First game of each (date, unordered team pair)."""
        return self._numbered.where(F.col("_rn") == 1).drop("_rn")

    @cached_property
    def _numbered(self) -> DataFrame:
        w = W.partitionBy("game_date", F.least("home_team", "away_team"),
                          F.greatest("home_team", "away_team")).orderBy("game_id")
        return self.game.withColumn("_rn", F.row_number().over(w))

    @cached_property
    def game1(self) -> DataFrame:
        """Every game, with teams such that a pair plays once a day: the n-th
        game of a pair on a date is one of the n-th division's four teams.
        The season is the year moved by the pair, so a series has one."""
        up = 4 * (F.col("_rn") - 1).cast("bigint")
        g = self._numbered.withColumns({"home_team": F.col("home_team") + up, "away_team": F.col("away_team") + up})
        pair = (F.col("home_team") + F.col("away_team")) % 3
        return g.withColumn("season", F.year("game_date").cast("bigint") + 18 * (pair - 1)).drop("_rn")

    @cached_property
    def game_sides(self) -> DataFrame:
        """Long form: one row per game and side, ``is_home`` flag."""
        g = self.game1
        return g.select(
            "game_id", "game_date", "game_type", "game_label", "season",
            F.explode(F.array(
                F.struct(F.col("home_team").alias("team_id"), F.lit(True).alias("is_home"),
                         F.col("game_result").alias("wl")),
                F.struct(F.col("away_team").alias("team_id"), F.lit(False).alias("is_home"),
                         F.when(F.col("game_result") == "W", "L")
                          .when(F.col("game_result") == "L", "W").alias("wl")),
            )).alias("s")).select("game_id", "game_date", "game_type", "game_label", "season",
                                   "s.team_id", "s.is_home", "s.wl")

    @cached_property
    def games_all(self) -> DataFrame:
        """Box-score game table: one row per game and team, ``is_home`` flag."""
        s = self.game_sides
        return s.select(
            "game_id", "game_date",
            F.concat(F.lit("G"), F.col("game_id").cast("string"),
                     F.when(F.col("is_home"), F.lit(" home")).otherwise(F.lit(" away"))).alias("matchup"),
            "team_id",
            (F.lit(80) + (F.col("game_id") * F.when(F.col("is_home"), 1).otherwise(7)) % 41)
            .cast("bigint").alias("pts"),
            "wl",
            F.col("season").alias("season_year"),
            F.col("game_type").alias("season_type"),
            F.col("season").cast("string").alias("season"),
            "is_home")

    @cached_property
    def team_stat(self) -> DataFrame:
        """Team box score per game: (game_id, team_id, win)."""
        return self.game_sides.select(
            "game_id", "team_id",
            F.when(F.col("wl") == "W", 1).when(F.col("wl") == "L", 0).cast("bigint").alias("win"))

    @cached_property
    def elo_games(self) -> DataFrame:
        """Playoff forecast games, home-team view, with resolved team ids."""
        g = self.game1.where(F.col("game_type") == "Playoffs")
        k = F.col("game_id")
        home, away = F.col("home_team"), F.col("away_team")
        return g.select(
            k.cast("string").alias("game_id"),
            F.col("game_date").alias("date_game"),
            F.col("season").alias("year_id"),
            F.concat(F.lit("T"), home.cast("string")).alias("team_id"),
            F.concat(F.lit("T"), away.cast("string")).alias("opp_id"),
            F.concat(F.lit("Club "), home.cast("string")).alias("fran_id"),
            F.concat(F.lit("Club "), away.cast("string")).alias("opp_fran"),
            (F.lit(80) + k % 41).cast("bigint").alias("pts"),
            (F.lit(80) + (k * 7) % 41).cast("bigint").alias("opp_pts"),
            (F.lit(1400) + k % 200).cast("double").alias("elo_i"),
            (F.lit(1405) + k % 200).cast("double").alias("elo_n"),
            (F.lit(1450) + k % 150).cast("double").alias("opp_elo_i"),
            (F.lit(1445) + k % 150).cast("double").alias("opp_elo_n"),
            (F.lit(41) + k % 10).cast("double").alias("win_equiv"),
            F.lit("H").alias("game_location"),
            "game_result", "forecast",
            home.alias("kaggle_team_id"), away.alias("kaggle_opp_team_id"),
            home.alias("kaggle_home_team_id"))

    # -- quote: bookmaker prices from lineitem -----------------------------------
    @cached_property
    def quote_raw(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
        ln, q = F.col("l_linenumber"), F.col("l_quantity")
        base = F.lit(100.0) + F.lit(5.0) * q
        return li.select(
            F.col("l_orderkey").alias("game_id"),
            F.col("l_suppkey").alias("book_id"),
            ln.alias("line_no"),
            F.when(ln == 7, F.lit(0.0)).when(ln % 2 == 0, -base).otherwise(base).alias("price1"),
            F.when(ln == 6, F.lit(None).cast("double")).when(ln % 2 == 0, base)
             .otherwise(-base).alias("price2"),
        )

    @cached_property
    def quote(self) -> DataFrame:
        g = self.game1.select("game_id", F.col("home_team").alias("team_id"),
                             F.col("away_team").alias("a_team_id"))
        return self.quote_raw.join(g, "game_id", "inner")

    # -- player_line: box-score rows of playoff games ----------------------------
    @cached_property
    def player_line(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                       "l_quantity")
        g = self.game1.where(F.col("game_type") == "Playoffs")
        # a third of the lines are one person's; half of the suppliers are a person each, a quarter share their lines
        # among 8 persons, a quarter among 40, so that career thresholds decide something at every scale
        sup, order = F.col("l_suppkey").cast("bigint"), F.col("l_orderkey").cast("bigint")
        pid = (F.when((order + F.col("l_linenumber")) % 3 == 0, F.lit(0).cast("bigint"))
               .when(sup % 4 < 2, sup * 100).when(sup % 4 == 2, sup * 100 + order % 8).otherwise(sup * 100 + order % 40))
        home = pid % 2 == 0
        q = F.col("l_quantity")
        return (li.join(g, li.l_orderkey == g.game_id, "inner")
                .select(
                    pid.alias("person_id"),
                    F.concat(F.lit("P"), pid.cast("string")).alias("first_name"),
                    F.concat(F.lit("L"), pid.cast("string")).alias("last_name"),
                    "game_id",
                    F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("player_team_id"),
                    F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("opponent_team_id"),
                    F.when(home, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("player_home"),
                    F.when(home, F.when(F.col("game_result") == "W", 1).otherwise(0))
                     .otherwise(F.when(F.col("game_result") == "W", 0).otherwise(1))
                     .cast("bigint").alias("win"),
                    q.alias("num_minutes"),
                    q.cast("bigint").alias("points"),
                    F.col("l_linenumber").cast("bigint").alias("assists"),
                    (F.col("l_partkey") % 15).alias("rebounds_total"),
                    (F.col("l_partkey") % 4).alias("blocks"),
                    (F.col("l_suppkey") % 3).alias("steals"),
                    q.cast("bigint").alias("field_goals_attempted"),
                    F.floor(q / 2).cast("bigint").alias("field_goals_made"),
                    (F.col("l_linenumber") % 3).cast("bigint").alias("turnovers"),
                    "game_type", "game_label", "game_ts", "game_date",
                    F.col("game_ts").alias("game_date_time_est"),
                    F.col("series_game_number_raw").alias("series_game_number"),
                    F.col("season").alias("year_id"),
                ))

    # -- raw_stat: dirty strings ---------------------------------------------------
    @cached_property
    def raw_stat(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        ln = F.col("l_linenumber")
        q = F.col("l_quantity").cast("bigint").cast("string")
        return li.select(
            F.col("l_orderkey").alias("game_id"),
            ln.alias("line_no"),
            F.when(ln == 1, F.concat(q, F.lit(".0"))).when(ln == 2, F.lit("N/A"))
             .when(ln == 3, F.concat(F.lit("+"), q)).when(ln == 4, F.lit(""))
             .when(ln == 5, F.concat(q, F.lit(".5"))).otherwise(q).alias("pts_raw"),
            F.when(ln == 1, F.lit("Game 7")).when(ln == 2, F.lit("12"))
             .when(ln == 3, F.lit(None).cast("string")).when(ln == 4, F.lit("Final"))
             .otherwise(ln.cast("string")).alias("game_no_raw"),
        )

    # -- team_hist: validity intervals from nation ----------------------------------
    @cached_property
    def team_hist(self) -> DataFrame:
        n = self.t("nation").select("n_nationkey")
        k = F.col("n_nationkey")

        def rows(lo, hi, cond):
            return n.where(cond).select(
                (F.lit(1000) + k).cast("bigint").alias("team_id"),
                F.concat(F.lit("T"), k.cast("string")).alias("team_abbrev"),
                F.upper(F.concat(F.lit("club "), k.cast("string"))).alias("team_name"),
                F.lit(lo).cast("bigint").alias("season_founded"),
                F.lit(hi).cast("bigint").alias("season_active_till"))

        return rows(1970, 1989, k < 4).unionByName(rows(1990, None, k < 3))

    # -- game_code: codes to resolve -----------------------------------------------
    @cached_property
    def game_code(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.t("customer").select("c_custkey", "c_nationkey")
        k = F.col("o_orderkey")
        return (o.join(c, o.o_custkey == c.c_custkey, "inner").select(
            k.alias("game_id"),
            (F.year("o_orderdate").cast("bigint")
             + F.when(F.col("o_custkey") % 3 == 0, -18)
                .when(F.col("o_custkey") % 3 == 1, 0).otherwise(18)).alias("season"),
            F.when(k % 5 == 0, F.lit("ZZZ"))
             .otherwise(F.concat(F.lit("t"), (F.col("c_nationkey") % 4).cast("string"), F.lit(" ")))
             .alias("team_code"),
            F.concat(F.lit("Club "), (F.col("c_nationkey") % 4).cast("string")).alias("fran"),
            F.col("o_orderdate").cast("date").alias("game_date"),
        ))

    # -- series_quote: string odds with sentinels ------------------------------------
    @cached_property
    def series_quote(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        k = F.col("o_orderkey")
        home = (F.when(k % 11 == 0, F.lit("N/A")).when(k % 13 == 0, F.lit("0"))
                .when(k % 2 == 0, F.concat(F.lit("-"), (F.lit(100) + k % 400).cast("string")))
                .otherwise((F.lit(100) + k % 400).cast("string")))
        away = (F.when(k % 7 == 0, F.lit("N/A")).when(k % 17 == 0, F.lit("0"))
                .when(k % 2 == 1, F.concat(F.lit("-"), (F.lit(100) + k % 300).cast("string")))
                .otherwise((F.lit(100) + k % 300).cast("string")))
        return o.select(
            k.alias("series_key"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            _label(F.col("o_orderpriority")).alias("round"),
            home.alias("home_odds"), away.alias("away_odds"))

    # -- team names to parse ---------------------------------------------------------
    @cached_property
    def team_name_rows(self) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_orderdate")
        names = F.array(*[F.lit(n) for n in TEAM_NAMES])
        k = F.col("o_orderkey")
        return o.select(
            k.alias("row_id"),
            F.element_at(names, (k % len(TEAM_NAMES) + 1).cast("int")).alias("full_team_name"),
            F.concat(F.lit("T"), (k % 4).cast("string")).alias("team_abbrev"),
            F.year("o_orderdate").cast("bigint").alias("year"))
