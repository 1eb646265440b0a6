"""Per-person GLM (distributed Newton) vs MLlib's IRLS on the same design."""

import math
import random

import pytest
from pyspark.sql import functions as F

from overmark.operators import model as M


def synthetic(spark, groups=4, per=15, seed=11):
    random.seed(seed)
    rows = []
    for g in range(groups):
        eff = (g - 1.5) * 0.4
        for i in range(per):
            off = random.uniform(-1.5, 1.5)
            p = 1 / (1 + math.exp(-(eff + off)))
            y = 1 if random.random() < p else 0
            rows.append((g, f"F{g}", f"L{g}", y, off, random.uniform(30, 300)))
    # one person with all wins: no finite estimate
    for i in range(5):
        rows.append((99, "F99", "L99", 1, random.uniform(-1, 1), 100.0))
    df = spark.createDataFrame(rows, "person_id bigint, first_name string, last_name string, actual_win bigint, "
                                     "expected_logit double, series_minutes double")
    return df.withColumn("expected_win_prob", 1 / (1 + F.exp(-F.col("expected_logit"))))


def test_effects_match_mllib(spark):
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.regression import GeneralizedLinearRegression
    df = synthetic(spark)
    eff = {r["person_id"]: r for r in M.player_effects(df).collect()}
    assert eff[99]["separated"] and eff[99]["log_odds_over_expected"] is None
    assert eff[99]["p_value"] is None and eff[99]["std_error"] is None

    fit_df = df.where("person_id != 99").withColumn("w", F.col("series_minutes") / 36.0) \
        .withColumn("label", F.col("actual_win").cast("double")).withColumn("pid", F.col("person_id").cast("double"))
    enc = OneHotEncoder(inputCols=["pid"], outputCols=["features"], dropLast=False).fit(fit_df)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False, offsetCol="expected_logit",
                                      weightCol="w", maxIter=50, tol=1e-12)
    model = glr.fit(enc.transform(fit_df))
    se = model.summary.coefficientStandardErrors
    for g in range(4):
        assert abs(eff[g]["log_odds_over_expected"] - model.coefficients[g]) < 1e-6
        assert abs(eff[g]["std_error"] - se[g]) < 1e-6
        z = eff[g]["log_odds_over_expected"] / eff[g]["std_error"]
        assert abs(eff[g]["p_value"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
        assert eff[g]["ci_lower"] < eff[g]["log_odds_over_expected"] < eff[g]["ci_upper"]


def test_required_columns_and_row_guard(spark):
    df = synthetic(spark)
    with pytest.raises(ValueError, match="missing required columns"):
        M.player_effects(df.drop("expected_logit"))
    # rows outside the valid domain are ignored, not fitted
    bad = spark.createDataFrame([(0, "F0", "L0", 2, 0.1, 50.0, 0.5), (0, "F0", "L0", 1, 0.1, 0.0, 0.5),
                                 (0, "F0", "L0", None, 0.1, 50.0, 0.5)],
                                "person_id bigint, first_name string, last_name string, actual_win bigint, "
                                "expected_logit double, series_minutes double, expected_win_prob double")
    a = {r["person_id"]: r["log_odds_over_expected"] for r in M.player_effects(df).collect()}
    b = {r["person_id"]: r["log_odds_over_expected"] for r in M.player_effects(df.unionByName(bad)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-12


@pytest.mark.parametrize(("expected", "wins", "n", "root"), [
    (0.05, 6, 10, 3.3499), (0.02, 2, 3, 4.5850), (0.97, 6, 12, -3.4761), (0.15, 6, 10, 2.1401)])
def test_far_starts_converge(spark, expected, wins, n, root):
    """Outcomes far from expectation, where plain Newton overshoots."""
    off = math.log(expected / (1 - expected))
    rows = [(1, "F", "L", int(i < wins), off, 72.0, expected) for i in range(n)]
    df = spark.createDataFrame(rows, "person_id bigint, first_name string, last_name string, actual_win bigint, "
                                     "expected_logit double, series_minutes double, expected_win_prob double")
    r = M.player_effects(df).first()
    assert r["converged"] and abs(r["log_odds_over_expected"] - root) < 1e-3
    assert abs(r["log_odds_over_expected"] - (math.log(wins / (n - wins)) - off)) < 1e-8


def test_effects_are_exact_where_newton_is_hard(spark):
    """Hot persons with thousands of distinct offsets, far offsets, and
    outcomes far from expectation, against bisection on the rows."""
    random.seed(4)
    rows = []
    for p, n, spread, shift in ((1, 20000, 1.0, 0.3), (2, 400, 12.0, 0.0), (3, 300, 0.5, 8.0), (4, 60, 30.0, -3.0)):
        for i in range(n):
            off = random.gauss(0, spread)
            up = 1 / (1 + math.exp(-max(-700, min(700, off + shift))))
            y = (i % 2) if p == 4 else int(random.random() < up)
            rows.append((p, f"F{p}", f"L{p}", y, off, random.uniform(0.5, 300)))
        rows.append((p, f"F{p}", f"L{p}", 0, shift, 30.0))
        rows.append((p, f"F{p}", f"L{p}", 1, shift, 30.0))
    df = spark.createDataFrame(rows, "person_id bigint, first_name string, last_name string, actual_win bigint, "
                                     "expected_logit double, series_minutes double")
    got = {r["person_id"]: r for r in M.player_effects(df.withColumn("expected_win_prob", F.lit(0.5))).collect()}
    for p in (1, 2, 3, 4):
        mine = [(r[3], r[4], r[5] / 36) for r in rows if r[0] == p]
        mu = lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        lo, hi = -60.0, 60.0
        for _ in range(100):
            mid = (lo + hi) / 2
            score = math.fsum(w * (y - mu(mid + o)) for y, o, w in mine)
            lo, hi = (mid, hi) if score > 0 else (lo, mid)
        info = math.fsum(w * mu(lo + o) * (1 - mu(lo + o)) for _, o, w in mine)
        assert got[p]["converged"] and not got[p]["separated"]
        assert abs(got[p]["log_odds_over_expected"] - lo) < 1e-8
        assert abs(got[p]["std_error"] * math.sqrt(info) - 1) < 1e-8


def test_normal_tail(spark):
    from overmark.functions.stats import two_sided_p
    zs = [0.0, 1e-9, 0.3, -1.0, 1.959963984540054, 2.999999, 3.0, -3.5, 5.0, 8.0, 20.0, 37.0, None]
    for z, p in spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_p(F.col("z"))).collect():
        if z is None:
            assert p is None
        else:
            assert abs(p - math.erfc(abs(z) / math.sqrt(2))) <= 1e-12 * math.erfc(abs(z) / math.sqrt(2)) + 1e-300


def test_effects_read_the_rows_once_and_use_no_python(spark, tmp_path):
    src = synthetic(spark)
    src.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    cells = M.effect_cells(rows, "person_id", ["first_name", "last_name"], "actual_win", "expected_logit",
                           "series_minutes")
    text = cells._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("hashpartitioning") == 1
    text = M.player_effects(rows)._jdf.queryExecution().toString()
    assert str(tmp_path) not in text            # what follows reads the cells only
    assert "Python" not in text and "ArrowEval" not in text
    assert M.player_effects(rows.limit(0)).count() == 0
