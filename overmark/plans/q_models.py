"""Staging and curated models built by name on rows (STG-*, CUR-*), and the
build into the catalog (SNK-2 to SNK-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import conform as cf
from ..session import scratch_path
from ..sources.catalog import test_catalog
from ..sources.specs import DERIVED_MODELS, STAGING_FILTERS, STAGING_SPECS
from .build import build
from .models import CURATED, SAME, Warehouse
from ..streaming.landing import landing_with_rejects
from .raw_exports import export, raw_catalog, staging_sql
from .registry import query

# The models with a pivot, rating or matching step have queries of their own operators; this one looks
# missing ids up by city, name and year.
BACKFILLED = "stg_nba_kaggle_player_statistics"


def _staging_sql(model: str) -> str:
    base, extra = DERIVED_MODELS.get(model, (model, None))
    where = [x for x in (STAGING_FILTERS.get(base), extra) if x]
    sql = f"select * from ({staging_sql(base)})" + (f" where {' and '.join(where)}" if where else "")
    if model != BACKFILLED:
        return sql
    ids = ", ".join(f"""coalesce({side}_team_id_raw, (select min(h.team_id) from hist h
        where lower(trim(h.team_city)) = lower(trim({side}_team_city))
          and lower(trim(h.team_name)) = lower(trim({side}_team_name))
          and year(game_date_time_est) between h.season_founded and h.season_active_till)) as {side}_team_id"""
                    for side in ("player", "opponent"))
    return (f"with hist as ({_staging_sql('stg_nba_kaggle_team_histories')}) "
            f"select * exclude (player_team_id_raw, opponent_team_id_raw), {ids} from ({sql})")


def _curated_sql(model: str) -> str:
    """What the curated model is by its definition, over the typed values."""
    parent, series, label, number, rename, _ = CURATED[model]
    names = [r.name.replace("_id_raw", "_id") for r in cf.staging_rules(parent)]
    out = []
    for c in names:
        if c == "game_label" and label:
            out.append("case game_label when 'East - First Round' then 'East First Round' else game_label end as game_label")
        elif c == "series_game_number" and number == "fix":
            out.append("case when series_game_number in ('1', '10', '11') then 1.0::double "
                       "else try_cast(series_game_number as double) end as series_game_number")
        elif c == "series_game_number" and number == "cast":
            out.append("try_cast(series_game_number as double) as series_game_number")
        elif c == "game_date_time_est" and rename:
            out.append("game_date_time_est as game_datetime_est")
        else:
            out.append(c)
    if series:
        out.append("cast(extract(year from game_date_time_est) as varchar) || case game_label "
                   "when 'East - First Round' then 'eastfirstround' when 'NBA Finals' then 'nbafinals' end as series_id")
    return f"select {', '.join(out)} from ({_staging_sql(parent)})"


def _register(model: str, sql: str) -> None:
    @query(f"model_{model}", sql=sql)
    def run(spark, sf_dir):
        df = Warehouse(raw_catalog(spark, sf_dir)).model(model)
        # lists of one-field structs are shown as lists of the field
        return df.select(*[F.col(f"{f.name}.element").alias(f.name) if isinstance(f.dataType, cf.T.ArrayType)
                           else F.col(f.name) for f in df.schema])


for _m in (*STAGING_SPECS, *DERIVED_MODELS):
    _register(_m, _staging_sql(_m))
for _m, _p in SAME.items():
    if _p in STAGING_SPECS:
        _register(_m, _staging_sql(_p))
for _m in CURATED:
    _register(_m, _curated_sql(_m))


DESCRIBED = {"stg_nba_kaggle_games": ("games as landed", {"game_id": "league's number of the game"}),
             "nba_kaggle_games": ("games, one row each", {"series_id": "year and round label"})}


@query("catalog_build", sql=f"""
select count(*) as n_games, count(series_id) as n_in_series, count(distinct series_id) as n_series,
  sum(series_game_number) as sum_game_number, 'view' as kind, 'games, one row each' as about,
  'year and round label' as about_series, 'games as landed' as about_parent
from ({_curated_sql("nba_kaggle_games")})
""")
def q_catalog_build(spark, sf_dir):
    """Two builds into a schema of the catalog, the second replacing the first's table under the persistent view;
    the view is read by its name, its descriptions from the catalog."""
    for _ in range(2):
        done = build(Warehouse(raw_catalog(spark, sf_dir)), ["nba_kaggle_games"], "overmark_", descriptions=DESCRIBED)
    name = done.name_of("nba_kaggle_games")
    about = {c.name: c.description for c in spark.catalog.listColumns(name)}
    t, parent = spark.catalog.getTable(name), spark.catalog.getTable(done.name_of("stg_nba_kaggle_games"))
    return spark.table(name).agg(
        F.count(F.lit(1)).alias("n_games"), F.count("series_id").alias("n_in_series"),
        F.count_distinct("series_id").alias("n_series"), F.sum("series_game_number").alias("sum_game_number"),
        F.lit(t.tableType.lower()).alias("kind"), F.lit(t.description).alias("about"),
        F.lit(about["series_id"]).alias("about_series"), F.lit(parent.description).alias("about_parent"))


LANDED = "stg_nba_betting_totals"


def _csv_lines(spark, sf_dir):
    """(file number, line) of exports: a file per 20,000 keys, every other one with its columns reversed, with
    lines that have a field too many or too few or an open quote, and a file whose header lacks a column."""
    raw = export(test_catalog(spark, sf_dir).scan("orders").select(
        F.col("o_orderkey").cast("bigint").alias("k"), F.to_date("o_orderdate").alias("d")), LANDED, keep=["k"])
    names = [c for c in raw.columns if c != "k"]
    text = lambda cols: F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cols])
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) if c == "book_name" else F.col(c) for c in names]
    line = F.when(F.col("k") % 50 == 7, F.concat(text(quoted), F.lit(",surplus"))) \
        .when(F.col("k") % 50 == 6, text(quoted[1:])).when(F.col("k") % 50 == 5, F.concat(text(quoted), F.lit('"'))) \
        .when(F.floor(F.col("k") / 20000) % 2 == 1, text(quoted[::-1])).otherwise(text(quoted))
    rows = raw.select(F.floor(F.col("k") / 20000).alias("part"), F.lit(1).alias("o"), line.alias("line"))
    heads = rows.select("part").distinct().select(
        "part", F.lit(0), F.when(F.col("part") % 2 == 1, F.lit(",".join(names[::-1]))).otherwise(F.lit(",".join(names))))
    short = raw.where(F.col("k") % 500 == 1).select(F.lit(-1).cast("bigint"), F.lit(1), text(quoted[1:]))
    return rows.union(heads).union(short).union(
        spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(0), F.lit(",".join(names[1:]))))


@query("landing_rejects", sql=f"""
with o as (select cast(o_orderkey as bigint) as k, cast(o_orderdate as date) as d from orders),
good as (select * from ({staging_sql(LANDED, "k % 50 not in (5, 6, 7)")}))
select 'landed' as outcome, count(*) as n_lines, sum(book_id) as sum_book_id, sum(total1) as sum_total1,
  count(book_name) as n_named from good
union all select 'fields', count(*), null, null, null from o where k % 50 in (6, 7)
union all select 'quotes', count(*), null, null, null from o where k % 50 = 5
union all select 'header: game_id', count(*), null, null, null from o where k % 500 = 1
""")
def q_landing_rejects(spark, sf_dir):
    """CSV exports streamed into conformed rows and rejects, in two runs of the job over one checkpoint."""
    src, out, bad, ck = (scratch_path(spark, f"landing_{x}") for x in ("src", "out", "rejects", "checkpoint"))
    lines = _csv_lines(spark, sf_dir)
    for first in (True, False):
        now = lines.where(F.col("part") <= 0 if first else F.col("part") > 0)
        (now.repartition("part").sortWithinPartitions("part", "o").select(F.col("part").alias("p"), F.col("line").alias("value"))
         .write.mode("append").partitionBy("p").text(src))
        landing_with_rejects(spark, src, LANDED, out, bad, ck).awaitTermination()
    landed = spark.read.parquet(out).agg(
        F.lit("landed").alias("outcome"), F.count(F.lit(1)).alias("n_lines"), F.sum("book_id").alias("sum_book_id"),
        F.sum("total1").alias("sum_total1"), F.count("book_name").alias("n_named"))
    return landed.union(spark.read.parquet(bad).groupBy("reason").agg(
        F.count(F.lit(1)), F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("bigint")))
