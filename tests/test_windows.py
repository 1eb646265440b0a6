"""Cumulative windows over range pieces equal the plain SQL windows, under skew."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overmark.operators import common as C
from overmark.operators import prefix as P


def skewed(spark, n=3000, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else random.randint(1, 40)          # key 0 holds a third of all rows
        ts = random.randint(0, 200)                                # many ties → peers
        v = None if i % 17 == 0 else round(random.uniform(-1, 1), 3)
        rows.append((key, ts, i, v))
    return spark.createDataFrame(rows, "k bigint, ts bigint, id bigint, v double")


def _cmp(a, b, key="id", col="r"):
    da = {r[key]: r[col] for r in a.collect()}
    db = {r[key]: r[col] for r in b.collect()}
    assert da.keys() == db.keys()
    for k in da:
        if da[k] is None or db[k] is None:
            assert da[k] is None and db[k] is None, k
        else:
            assert abs(da[k] - db[k]) < 1e-9, (k, da[k], db[k])


def test_running_sum_rows_matches_window(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    plain = df.select("id", F.sum("v").over(w).alias("r"))
    two = C.running_sum(df, ["k"], ["ts", "id"], "v", "r", "rows", piece_rows=64).select("id", "r")
    _cmp(two, plain)


def test_running_sum_range_includes_peers(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("ts")
    plain = df.select("id", F.sum("v").over(w).alias("r"))
    two = C.running_sum(df, ["k"], ["ts"], "v", "r", "range", piece_rows=64).select("id", "r")
    _cmp(two, plain)


def test_running_count_and_avg(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("ts")
    plain = df.select("id", F.avg("v").over(w).alias("r"))
    two = C.running_avg(df, ["k"], ["ts"], "v", "r", "range", piece_rows=64).select("id", "r")
    _cmp(two, plain)
    wr = W.partitionBy("k").orderBy("ts", "id")
    p2 = df.select("id", F.row_number().over(wr).cast("double").alias("r"))
    t2 = C.running_count(df, ["k"], ["ts", "id"], "r", "rows", piece_rows=64).select(
        "id", F.col("r").cast("double").alias("r"))
    _cmp(t2, p2)


def test_dense_rank_by_matches_window(spark):
    df = skewed(spark).withColumn("ts", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("ts")))
    w = W.partitionBy("k").orderBy("ts")
    plain = df.select("id", F.dense_rank().over(w).cast("double").alias("r"))
    two = C.dense_rank_by(df, ["k"], "ts", "r", piece_rows=64).select("id", F.col("r").cast("double").alias("r"))
    _cmp(two, plain)


def test_last_non_null_by_order(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (1, 4, None), (2, 1, None)],
                               "k bigint, o bigint, v double")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(C.last_non_null("v", "o").alias("x")).collect()}
    assert got == {1: 7.0, 2: None}


def test_null_keys_form_one_partition(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (7, 2, 5.0), (7, None, 1.0), (None, 2, 4.0)],
                               "k bigint, ts bigint, v double").withColumn("id", F.monotonically_increasing_id())
    w = W.partitionBy("k").orderBy("ts")
    want = sorted(map(str, df.select("id", F.dense_rank().over(w).cast("bigint").alias("r")).collect()))
    assert sorted(map(str, C.dense_rank_by(df, ["k"], "ts", "r").select("id", "r").collect())) == want
    some = df.where("ts IS NOT NULL")
    want = sorted(map(str, some.select("id", F.sum("v").over(w).alias("r")).collect()))
    assert sorted(map(str, C.running_sum(some, ["k"], ["ts"], "v", "r", "range").select("id", "r").collect())) == want


def test_a_hot_key_covers_many_pieces_of_bounded_size(spark):
    """A key with a third of all rows, running over many pieces; no piece
    holds more than twice its planned share."""
    n, piece = 400_000, 10_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 10).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)).alias("ts"), "id", (F.col("id") % 5).cast("double").alias("v"))
    cut, pieces = P.pieces(df, ["k"], ["ts", "id"], piece)
    sizes = {r["_piece"]: r["count"] for r in cut.groupBy("_piece").count().collect()}
    assert pieces == 40 and sum(sizes.values()) == n and max(sizes.values()) <= 2 * piece
    hot = cut.where("k = 7").select("_piece").distinct().count()
    assert hot > 10
    got = P.running_aggs(df, ["k"], ["ts", "id"], {"r": ("sum", "v"), "c": ("count", F.lit(1))}, piece_rows=piece)
    w = W.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.sum("v").over(w).alias("r0"), F.row_number().over(w).alias("c0"))
    assert got.join(want, "id").where("r <> r0 OR c <> c0").count() == 0 and got.count() == n


def test_carry_holds_one_row_a_piece_at_most(spark):
    df = skewed(spark)
    plan = P.running_sum(df, ["k"], ["ts", "id"], "v", "r", piece_rows=64)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "percentile" not in text
    cut, n = P.pieces(df, ["k"], ["ts", "id"], 64)
    held = {(r["_piece"], r["k"]) for r in cut.select("_piece", "k").distinct().collect()}
    continued = [(p, k) for p, k in held if any(q < p and j == k for q, j in held)]
    assert 0 < len(continued) < n and len({p for p, _ in continued}) == len(continued)
    assert all(k == min(j for q, j in held if q == p) for p, k in continued)


def test_peers_beyond_a_piece_and_frames(spark):
    """All rows of a key tie; text and descending orders; NULL orders; empty."""
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit("same").alias("ts"), "id", F.lit(1.0).alias("v"))
    got = P.running_sum(df, ["k"], ["ts"], "v", "r", "range", piece_rows=32)
    assert {r["r"] for r in got.collect()} == {500.0}
    down = P.running_count(df, ["k"], [F.col("id").desc()], "r", piece_rows=32)
    assert all(r["r"] == 500 - r["id"] for r in down.collect())
    nulls = skewed(spark).withColumn("ts", F.when(F.col("id") % 9 != 0, F.col("ts")))
    w = W.partitionBy("k").orderBy("ts")
    _cmp(P.running_avg(nulls, ["k"], ["ts"], "v", "r", "range", piece_rows=50), nulls.select("id", F.avg("v").over(w).alias("r")))
    assert P.running_sum(df.limit(0), ["k"], ["id"], "v", "r").count() == 0
    assert P.dense_rank_by(df.limit(0), ["k"], "id", "r").count() == 0
