"""Raw exports: tasks are cut by rows, columns are plain expressions."""

from __future__ import annotations

import datetime

from overmark.plans import raw_exports as RX
from overmark.plans.models import Warehouse


def test_one_small_file_is_exported_by_many_tasks(spark, tmp_path):
    n = 2 * RX.TASK_ROWS + 1
    (spark.range(n).selectExpr("id as o_orderkey", "timestamp '1996-01-05' as o_orderdate").coalesce(1)
     .write.parquet(str(tmp_path / "orders.parquet")))
    got = Warehouse(RX.raw_catalog(spark, str(tmp_path))).model("nba_kaggle_team_statistics_extended")
    assert got.rdd.getNumPartitions() == 3 and got.count() == n
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cells_follow_key_and_column_number(spark):
    base = spark.createDataFrame([(7, datetime.date(1996, 1, 5))], "k bigint, d date")
    row = RX.export(base, "stg_nba_betting_totals").first().asDict()
    rules = {r.raw: (j, r) for j, r in enumerate(RX.cf.staging_rules("stg_nba_betting_totals"))}
    j, rule = rules["total1"]
    assert rule.kind == "f" and (7 + 5 * j) % 11 > 2
    assert row["total1"] == f"{(7 * (j + 3) + j) % 997}.25"
