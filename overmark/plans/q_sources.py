"""Queries over sources, sinks and the conformer (SRC-*, SNK-*, D-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import conform as cf
from ..sources import sinks
from ..sources.catalog import test_catalog
from ..session import scratch_path
from . import oracle_bindings as ob
from .bindings import Bindings
from .registry import query


@query("src_scan", sql="""
select o_orderkey, o_custkey, o_totalprice, o_orderdate
from orders
where o_orderdate >= timestamp '1998-01-01' and o_orderstatus = 'F'
""")
def q_src_scan(spark, sf_dir):
    """Scan by logical name; the filter and the 4-column projection reach the
    Parquet reader (PushedFilters / pruned ReadSchema)."""
    cat = test_catalog(spark, sf_dir)
    return (cat.scan("orders")
            .where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                   & (F.col("o_orderstatus") == "F"))
            .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))


RAW_STAT_SPEC = "game_id:i line_no:i pts_raw>pts:ir+ game_no_raw>game_no:s"


@query("src_string_first", sql=ob.with_("raw_stat") + """
select game_id, cast(line_no as bigint) as line_no,
  case when regexp_full_match(trim(replace(pts_raw, '+', '')), '[+-]?[0-9]+(\\.[0-9]*)?')
       then cast(round(cast(trim(replace(pts_raw, '+', '')) as double)) as bigint) end as pts,
  game_no_raw as game_no
from raw_stat
""")
def q_src_string_first(spark, sf_dir):
    """Land an export as all-string CSV (no type inference), read it back
    string-first and conform it with a column spec."""
    b = Bindings(spark, sf_dir)
    path = scratch_path(spark, "raw_stat_csv")
    # the export's columns come in another order than the schema's: the header's names bind
    b.raw_stat.select(*reversed(b.raw_stat.columns)).write.mode("overwrite").option("header", True).csv(path)
    schema = cf.T.StructType([cf.T.StructField(c, cf.T.StringType()) for c in b.raw_stat.columns])
    landed = cf.land_strings(spark, path, schema)
    return cf.conform(landed, RAW_STAT_SPEC)


@query("sink_table_roundtrip", sql=ob.with_("game") + """
select game_id, game_date, season, home_team, away_team, game_type, game_label, forecast,
  game_result from game
""")
def q_sink_table_roundtrip(spark, sf_dir):
    """Materialise as a partitioned Parquet table in the shared folder and
    read it back (the table lineage restarts from the files)."""
    b = Bindings(spark, sf_dir)
    g = b.game.select("game_id", "game_date", "season", "home_team", "away_team", "game_type",
                      "game_label", "forecast", "game_result")
    out = sinks.materialize(g, "game_table", partition_by=["game_type"])
    return out.select(*g.columns)


# Landed header names, as an export or a scraped table has them.
LANDED_HEADERS = {
    "o_orderkey": "Order-Key",
    "o_totalprice": "Home/Away-Odds (%)",
    "o_orderpriority": "  Priority / Level ",
    "o_orderstatus": "W-L",
}


@query("normalize_columns", sql="""
select o_orderkey as order_key, o_totalprice as home_away_odds,
  trim(o_orderpriority) as priority_level, trim(o_orderstatus) as w_l
from orders
""")
def q_normalize_columns(spark, sf_dir):
    o = test_catalog(spark, sf_dir).scan("orders")
    landed = o.select(*[F.col(k).alias(v) for k, v in LANDED_HEADERS.items()])
    return cf.normalize_columns(landed)


@query("nested_list_unwrap", sql="""
select doc_id, cast(len(w) as int) as n_words, w[1] as first_word, w[len(w)] as last_word,
  array_to_string(w, ' ') as rejoined
from (select doc_id, string_split(text, ' ') as w from documents)
""")
def q_nested_list_unwrap(spark, sf_dir):
    """Parquet LIST<string> as struct<list: array<struct<element>>> → array."""
    d = test_catalog(spark, sf_dir).scan("documents").select("doc_id", "text")
    nested = d.select("doc_id", F.struct(F.transform(F.split("text", " ", -1),
                                                     lambda w: F.struct(w.alias("element")))
                                         .alias("list")).alias("words"))
    w = cf.unwrap_list("words")
    return nested.select("doc_id", F.size(w).alias("n_words"), F.get(w, 0).alias("first_word"),
                         F.element_at(w, -1).alias("last_word"),
                         F.array_join(w, " ").alias("rejoined"))


@query("preview_limit", sql="""
select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 5
""")
def q_preview_limit(spark, sf_dir):
    o = test_catalog(spark, sf_dir).scan("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sinks.preview(o, 5, order_by=["o_orderkey"])


# A raw player-statistics export in the string-first shape of the source
# table, derived from lineitem: the spec of the staging model conforms it.
def raw_player_statistics(b: Bindings):
    li = b.t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                                "l_shipdate")
    q = F.col("l_quantity").cast("bigint").cast("string")
    ln = F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("P"), (F.col("l_suppkey") % 20).cast("string")).alias("firstName"),
        F.concat((F.col("l_suppkey") % 20).cast("string"), F.lit(".0")).alias("personId"),
        F.col("l_orderkey").cast("string").alias("gameId"),
        F.col("l_shipdate").cast("string").alias("gameDateTimeEst"),
        F.when(ln == 2, F.lit("N/A")).when(ln == 5, F.concat(q, F.lit(".5")))
         .otherwise(q).alias("points"),
        F.when(ln % 2 == 0, F.concat(F.lit("+"), q)).otherwise(F.concat(F.lit("-"), q))
         .alias("plusMinusPoints"),
        F.col("l_quantity").cast("string").alias("numMinutes"),
        (F.col("l_suppkey") % 2).cast("string").alias("home"),
        F.when(ln == 4, F.lit("")).otherwise(F.col("l_shipdate").cast("date").cast("string"))
         .alias("gameDate"),
        F.col("l_suppkey").cast("string").alias("playerteamId"),
    )


@query("conform_table", sql="""
with raw as (
  select 'P' || cast(l_suppkey % 20 as varchar) as first_name,
    cast(l_suppkey % 20 as varchar) || '.0' as person_id_raw,
    cast(l_orderkey as varchar) as game_id_raw,
    l_shipdate as ts,
    case when l_linenumber = 2 then 'N/A'
         when l_linenumber = 5 then cast(cast(l_quantity as bigint) as varchar) || '.5'
         else cast(cast(l_quantity as bigint) as varchar) end as points_raw,
    case when l_linenumber % 2 = 0 then '+' else '-' end || cast(cast(l_quantity as bigint) as varchar) as pm_raw,
    l_quantity as num_minutes,
    l_suppkey % 2 as home,
    case when l_linenumber = 4 then '' else cast(cast(l_shipdate as date) as varchar) end as game_date_raw,
    l_suppkey as team
  from lineitem)
select first_name, cast(null as varchar) as last_name,
  cast(round(try_cast(person_id_raw as double)) as bigint) as person_id,
  cast(round(try_cast(game_id_raw as double)) as bigint) as game_id,
  cast(ts as timestamp) as game_date_time_est,
  cast(null as varchar) as player_team_city, cast(null as varchar) as player_team_name,
  cast(null as varchar) as opponent_team_city, cast(null as varchar) as opponent_team_name,
  cast(null as varchar) as game_type, cast(null as varchar) as game_label,
  cast(null as varchar) as series_game_number, cast(null as varchar) as game_sub_label,
  cast(null as bigint) as win, cast(home as bigint) as home, num_minutes,
  cast(round(try_cast(points_raw as double)) as bigint) as points,
  cast(null as bigint) as assists, cast(null as bigint) as blocks, cast(null as bigint) as steals,
  cast(null as bigint) as field_goals_attempted, cast(null as bigint) as field_goals_made,
  cast(null as double) as field_goals_percentage,
  cast(null as bigint) as three_pointers_attempted, cast(null as bigint) as three_pointers_made,
  cast(null as double) as three_pointers_percentage,
  cast(null as bigint) as free_throws_attempted, cast(null as bigint) as free_throws_made,
  cast(null as double) as free_throws_percentage,
  cast(null as bigint) as rebounds_defensive, cast(null as bigint) as rebounds_offensive,
  cast(null as bigint) as rebounds_total, cast(null as bigint) as fouls_personal,
  cast(null as bigint) as turnovers,
  cast(round(try_cast(replace(pm_raw, '+', '') as double)) as bigint) as plus_minus_points,
  cast(team as bigint) as player_team_id_raw, cast(null as bigint) as opponent_team_id_raw,
  cast(null as varchar) as comment, cast(null as varchar) as starting_position,
  try_cast(game_date_raw as date) as game_date
from raw
""")
def q_conform_table(spark, sf_dir):
    """The player-statistics staging spec applied to a string-first export."""
    b = Bindings(spark, sf_dir)
    raw = raw_player_statistics(b)
    absent = tuple(r.raw for r in cf.staging_rules("stg_nba_kaggle_player_statistics") if r.raw not in raw.columns)
    return cf.conform_model(raw, "stg_nba_kaggle_player_statistics", optional=absent)
