"""Streaming landing: files conformed exactly once across restarts."""

from pyspark.sql import functions as F

from overmark.session import scratch_path
from overmark.sources import conform as cf
from overmark.streaming.landing import landing_stream


def test_landing_stream_is_incremental(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("land_src", "land_out", "land_ckpt"))
    model = "stg_nba_kaggle_team_histories"
    cols = [f.name for f in cf.raw_string_schema(model).fields]

    def drop(batch, rows):
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
        df.coalesce(1).write.mode("append").option("header", True).csv(src)

    drop(1, [("1610612737", "Atlanta", "Hawks", "ATL", "1949", "", "NBA"),
             ("1", "X", "All-Stars", "ASX", "1950", "1951", "ABA")])
    q = landing_stream(spark, src, model, out, ck)
    q.awaitTermination(120)
    first = spark.read.parquet(out)
    assert first.count() == 1                       # league filter of the staging model
    assert first.first()["season_active_till"] is None   # '' → NULL via safe cast

    drop(2, [("1610612738", "Boston", "Celtics", "BOS", "1946", "2100", "NBA")])
    q = landing_stream(spark, src, model, out, ck)  # restart from the checkpoint
    q.awaitTermination(120)
    again = spark.read.parquet(out)
    assert again.count() == 2                        # the first file is not landed twice
    assert sorted(r["team_abbrev"] for r in again.collect()) == ["ATL", "BOS"]


def test_lines_of_csv(spark):
    from overmark.streaming.landing import _value, csv_cells
    rows = ["a,b", ",b", "a,", "", ",", '"a,b",c', '"say ""hi""",', '""', 'a"b,c', '"open,c', '"a"b,c', "é,字"]
    raw, whole = csv_cells(F.col("l"))
    got = spark.createDataFrame([(r,) for r in rows], "l string").select("l", F.transform(raw, _value).alias("v"), whole.alias("w"))
    got = {r.l: (r.v if r.w else None) for r in got.collect()}
    assert got == {"a,b": ["a", "b"], ",b": [None, "b"], "a,": ["a", None], "": [None], ",": [None, None],
                   '"a,b",c': ["a,b", "c"], '"say ""hi""",': ['say "hi"', None], '""': [""], 'a"b,c': None,
                   '"open,c': None, '"a"b,c': None, "é,字": ["é", "字"]}


def test_landing_keeps_rejects_once(spark):
    from overmark.streaming.landing import landing_with_rejects
    src, out, bad, ck = (scratch_path(spark, n) for n in ("rej_src", "rej_out", "rej_bad", "rej_ckpt"))
    model = "stg_nba_kaggle_team_histories"
    cols = [f.name for f in cf.raw_string_schema(model).fields]

    def drop(text):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(src)

    def run():
        landing_with_rejects(spark, src, model, out, bad, ck).awaitTermination(120)
        rows = sorted(r.team_abbrev for r in spark.read.parquet(out).collect())
        return rows, sorted((r.reason, r.line) for r in spark.read.parquet(bad).collect())

    head = ",".join(cols)
    drop("\n".join([head, '1,"Fort Wayne, Ind.",Pistons,FWP,1948,1957,NBA', "2,X,Y,XXX,1,2,NBA,extra", "3,short",
                    head, '4,"open,Y,XXX,1,2,NBA', "", "5,A,B,ABC,1950,1951,ABA"]))
    first = [("fields", "2,X,Y,XXX,1,2,NBA,extra"), ("fields", "3,short"), ("quotes", '4,"open,Y,XXX,1,2,NBA')]
    assert run() == (["FWP"], first)
    assert run() == (["FWP"], first)                 # nothing new: nothing landed again
    drop("\n".join(["extra," + ",".join(cols[::-1]), "e,NBA,2100,1946,BOS,Celtics,Boston,9"]))
    drop("\n".join([",".join(cols[1:]), "a,b,c,1,2,NBA"]))
    drop("\n".join([head + ",teamId", "1,a,b,c,1,2,NBA,7"]))
    rows, rejects = run()
    assert rows == ["BOS", "FWP"]
    assert rejects == sorted([*first, ("header: teamId", "a,b,c,1,2,NBA"), ("header: teamId", "1,a,b,c,1,2,NBA,7")])
