"""Participant effects over expectation (D-24), timeline (D-25) and top
careers (D-26).

The effect model is a weighted binomial GLM with a logit offset, one
coefficient per person and no intercept.  Its design matrix is one-hot by
person, so the likelihood separates: every person's coefficient b solves

    sum w y = sum w mu(b + offset),   mu(x) = 1 / (1 + exp(-x)).

The left side is one number per person.  The right side needs the offsets
only through the weight near each of them: offsets are cut into cells of
width 1/32, and a cell keeps the moments sum w d^k, k = 0..4, of the distance
d from its middle.  mu(b + middle + d) is then its Taylor series, exact to
about 1e-12 a unit of weight.  Moments add, so cells are partial-aggregated
like any sum: one pass over the rows, a hot person's rows are summed map side
wherever they lie, and a person is left with few cells (the logit of a double
lies in [-745, 37], so there are at most 25,024).  Newton's method runs on
the cells of a person inside one expression; no further pass, no driver
loop, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.stats import let, two_sided_p
from ..sources.sinks import materialize
from .common import last_non_null
from .prefix import PIECE_ROWS, running_aggs

Z975 = 1.959963984540054  # standard normal 97.5% quantile
CELL = 32                 # cells a unit of the offset
MOMENTS = ["m0", "m1", "m2", "m3", "m4"]


def _score_parts(cells: Column, b: Column) -> Column:
    """struct(mean, info): sums over cells of w mu and of w mu (1 - mu) at
    ``b``, by the Taylor series of mu around each cell's middle."""
    at = F.transform(cells, lambda c: F.struct(
        c.alias("c"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-(b + c["middle"])))).alias("mu")))
    at = F.transform(at, lambda x: F.struct(
        x["c"].alias("c"), x["mu"].alias("mu"), (x["mu"] * (1 - x["mu"])).alias("s"), (1 - 2 * x["mu"]).alias("q")))

    def add(total, x):
        m, s, q = x["c"], x["s"], x["q"]
        d = [x["mu"], s, s * q, s * (1 - 6 * s), s * q * (1 - 12 * s), s * (1 - 30 * s + 120 * s * s)]
        taylor = lambda k: (m["m0"] * d[k] + m["m1"] * d[k + 1] + m["m2"] * d[k + 2] / 2 + m["m3"] * d[k + 3] / 6
                            + m["m4"] * d[k + 4] / 24)
        return F.struct((total["mean"] + taylor(0)).alias("mean"), (total["info"] + taylor(1)).alias("info"))

    zero = F.lit(0.0)
    return F.aggregate(at, F.struct(zero.alias("mean"), zero.alias("info")), add)


def _solve(cells: Column, wins: Column, lo: Column, hi: Column, start: Column, max_iter: int, tol: float) -> Column:
    """struct(b, delta, info): the root of wins = mean(b) in [lo, hi] by
    Newton steps; one that leaves the bracket is replaced by its middle."""
    none = F.lit(None).cast("double")
    state = lambda lo, hi, b, delta: F.struct(lo.alias("lo"), hi.alias("hi"), b.alias("b"), delta.alias("delta"))

    def step(x, _):
        def move(p):
            score = wins - p["mean"]
            low = F.when(score > 0, x["b"]).otherwise(x["lo"])
            high = F.when(score < 0, x["b"]).otherwise(x["hi"])
            newton = x["b"] + F.try_divide(score, p["info"])
            nxt = (F.when(score == 0, x["b"]).when((newton >= low) & (newton <= high), newton)
                   .otherwise((low + high) / 2))
            return let(nxt, lambda n: state(low, high, n, F.abs(n - x["b"])))
        return F.when(x["delta"] < tol, x).otherwise(let(_score_parts(cells, x["b"]), move))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), state(lo, hi, start, none), step)
    return let(done, lambda x: F.struct(x["b"].alias("b"), x["delta"].alias("delta"),
                                        _score_parts(cells, x["b"])["info"].alias("info")))


def effect_cells(rows: DataFrame, person: str, names: list[str], y: str, offset: str, minutes: str) -> DataFrame:
    """Sufficient statistics of the effect model per (person, names, cell)."""
    d = rows.select(F.col(person).alias("_p"), *names, F.col(y).cast("double").alias("_y"),
                    F.col(offset).cast("double").alias("_o"), (F.col(minutes) / 36.0).alias("_w"))
    d = d.withColumn("_cell", F.round(F.col("_o") * CELL).cast("long"))
    away = F.col("_o") - F.col("_cell") / F.lit(float(CELL))
    moment, sums = F.col("_w"), []
    for m in MOMENTS:
        sums.append(F.sum(moment).alias(m))
        moment = moment * away
    return d.groupBy("_p", *names, "_cell").agg(
        *sums, F.sum(F.col("_w") * F.col("_y")).alias("_wins"), F.sum("_y").alias("_ny"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_w") * F.col("_o")).alias("_wo"), F.min("_o").alias("_omin"), F.max("_o").alias("_omax"))


def player_effects(rows: DataFrame, person: str = "person_id", y: str = "actual_win",
                   offset: str = "expected_logit", minutes: str = "series_minutes",
                   max_iter: int = 100, tol: float = 1e-10) -> DataFrame:
    """D-24: per-person log-odds over expectation with standard error, z,
    two-sided p, 95% CI and exponentiated forms, joined to the person's
    names and sorted by the coefficient (descending).

    A person whose outcomes are all wins or all losses has no finite
    estimate: the coefficient columns are NULL and ``separated`` is true.
    ``converged`` tells whether the last step was below ``tol``.

    The input is guarded first: the required columns must exist, rows with
    a NULL in any of them are dropped, and only rows with an outcome of 0/1,
    an expectation strictly inside (0, 1) and positive minutes are kept.
    """
    names = ["first_name", "last_name"]
    required = [person, *names, y, "expected_win_prob", offset, minutes]
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    rows = (rows.dropna(subset=required)
            .where(F.col(y).try_cast("bigint").isin(0, 1)
                   & (F.col("expected_win_prob") > 0) & (F.col("expected_win_prob") < 1)
                   & (F.col(minutes) > 0)))
    cells = materialize(effect_cells(rows, person, names, y, offset, minutes), "glm_cells")
    sums = [F.sum(c).alias(c) for c in (*MOMENTS, "_wins", "_ny", "_n", "_wo")]
    per_cell = cells.groupBy("_p", "_cell").agg(*sums, F.min("_omin").alias("_omin"), F.max("_omax").alias("_omax"))
    cell = F.struct("_cell", (F.col("_cell") / F.lit(float(CELL))).alias("middle"), *MOMENTS)
    per = per_cell.groupBy("_p").agg(
        F.array_sort(F.collect_list(cell)).alias("_cells"), F.sum("m0").alias("_w"),
        *[F.sum(c).alias(c) for c in ("_wins", "_ny", "_n", "_wo")],
        F.min("_omin").alias("_omin"), F.max("_omax").alias("_omax"))
    per = per.withColumn("separated", (F.col("_ny") == 0) | (F.col("_ny") == F.col("_n")))
    # The root lies between logit(ybar) - max(offset) and logit(ybar) - min(offset), ybar being the weighted mean
    # outcome: a bracket that Newton steps must stay in; the mean offset, inside it, is the start.
    logit = F.log(F.col("_wins") / (F.col("_w") - F.col("_wins")))
    per = per.withColumn("_logit", F.when(~F.col("separated"), logit))
    per = per.withColumns({"_lo": F.col("_logit") - F.col("_omax"), "_hi": F.col("_logit") - F.col("_omin")})
    start = F.least(F.greatest(F.col("_logit") - F.col("_wo") / F.col("_w"), F.col("_lo")), F.col("_hi"))
    fit = per.select("_p", "separated", F.when(~F.col("separated"), _solve(
        F.col("_cells"), F.col("_wins"), F.col("_lo"), F.col("_hi"), start, max_iter, tol)).alias("_fit"))
    coef = fit.select(
        F.col("_p").alias(person), "separated", F.coalesce(F.col("_fit.delta") < tol, F.lit(False)).alias("converged"),
        F.col("_fit.b").alias("log_odds_over_expected"),
        F.try_divide(F.lit(1.0), F.sqrt(F.col("_fit.info"))).alias("std_error"))
    coef = coef.withColumn("z", safe.safe_divide("log_odds_over_expected", "std_error"))
    coef = coef.select(
        "*",
        two_sided_p(F.col("z")).alias("p_value"),
        (F.col("log_odds_over_expected") - F.lit(Z975) * F.col("std_error")).alias("ci_lower"),
        (F.col("log_odds_over_expected") + F.lit(Z975) * F.col("std_error")).alias("ci_upper"))
    coef = coef.select(
        F.concat(F.lit(f"C({person})["), F.col(person).cast("string"), F.lit("]")).alias("player_term"), "*",
        F.exp("log_odds_over_expected").alias("odds_multiplier_over_expected"),
        F.exp("ci_lower").alias("odds_multiplier_ci_lower"),
        F.exp("ci_upper").alias("odds_multiplier_ci_upper"))
    spelled = cells.select(F.col("_p").alias(person), *names).distinct()
    out = coef.join(spelled, person, "left")
    out = out.withColumn("player_name", F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")))
    return out.orderBy(F.col("log_odds_over_expected").desc_nulls_last(), F.col(person))


TIMELINE_ORDER = ["series_start_date", "series_id", "year_id", "player_team_id", "opponent_team_id"]


def player_timeline(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """D-25: per person, series number in career order and the cumulative
    series residual (a NULL residual stays NULL; later rows continue).

    Career order is start date then series id (then season and sides, to
    make it total); the person key is the string form of the id.
    """
    df = rows.withColumns({
        "person_key": F.col("person_id").cast("string"),
        "player_name": safe.full_name("first_name", "last_name"),
    })
    df = running_aggs(df, ["person_key"], TIMELINE_ORDER,
                      {"player_series_number": ("count", F.lit(1)),
                       "_cum": ("sum", "series_residual")}, "rows", piece_rows)
    return (df.withColumn("player_series_number", F.col("player_series_number").cast("bigint"))
            .withColumn("career_cumulative_series_residual",
                        F.when(F.col("series_residual").isNotNull(), F.col("_cum")))
            .drop("_cum"))


def top_careers(timeline: DataFrame, k: int = 20) -> DataFrame:
    """D-26: the ``k`` careers with the highest final cumulative residual
    (last non-null value in series order), with series count and minutes,
    and their timeline rows.

    The per-career table is a partial-aggregated groupBy; the top-k is a
    TakeOrderedAndProject (k rows leave each partition); the timeline rows
    are kept with a semi-join against those k keys.
    """
    per = (timeline.groupBy("person_key", "player_name")
           .agg(last_non_null("career_cumulative_series_residual", "player_series_number")
                .alias("final_cumulative_residual"),
                F.count_distinct("series_id").alias("career_playoff_series"),
                F.sum("series_minutes").alias("career_playoff_minutes")))
    top = per.orderBy(F.col("final_cumulative_residual").desc_nulls_last(), F.col("person_key")).limit(k)
    keep = top.select("person_key", "final_cumulative_residual")
    return timeline.join(F.broadcast(keep), "person_key", "inner")
