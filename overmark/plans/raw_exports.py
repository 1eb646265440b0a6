"""Raw exports for every staging model, all strings, derived from ``orders``:
one row an order and a value in every column, some cells unreadable.

``form`` says how a rule's raw text is made of the order's key and date, and
``expected_sql`` what the model must make of it, from the numbers and not by
casting the text (DuckDB's casts accept what the models' casts refuse).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import conform as cf
from ..sources.catalog import Catalog, test_catalog
from ..sources.specs import STAGING_SPECS

TASK_ROWS = 25_000      # orders exported by one task

# Columns that filters, flags and series need in a form of their own, as SQL over k
# that both engines read.  They are never unreadable.
FORMS = {
    "league": "case when k % 3 = 0 then 'ABA' else 'NBA' end",
    "is_playoff": "cast(k % 2 as varchar(9))",
    "is_copy": "cast(k % 2 as varchar(9))",
    "game_label": "case when k % 4 = 0 then 'East - First Round' when k % 4 = 1 then 'NBA Finals' else null end",
    "team_city": "'C' || cast(k % 7 as varchar(9))",
    "player_team_city": "' c' || cast(k % 7 as varchar(9))",
    "team_name": "'N' || cast(k as varchar(9))",
    "player_team_name": "'n' || cast(k as varchar(9)) || ' '",
    "season_founded": "cast(1900 + k % 97 as varchar(9))",
    "season_active_till": "cast(1991 + k % 8 as varchar(9))",
    "series_game_number": "case when k % 5 = 0 then null else cast(k % 12 as varchar(9)) end",
}


def _number(j) -> str:
    return f"(k * ({j} + 3) + {j}) % 997"


def _state(j) -> str:
    return f"(k + 5 * {j}) % 11"


def form(rule: cf.ColumnRule) -> str:
    """Raw text by the kind of column, Spark SQL over k bigint, d date and the column's number j."""
    n, st = _number("j"), _state("j")
    if rule.round_int:
        plus = "'+'" if rule.strip_plus else "''"
        return (f"case {st} when 0 then '' when 1 then 'N/A' when 2 then concat({n}, '.5') "
                f"when 3 then concat({n}, '.0') else concat({plus}, {n}) end")
    if rule.kind == "i":
        return f"case {st} when 0 then '' when 1 then 'N/A' when 2 then concat({n}, '.0') else cast({n} as string) end"
    if rule.kind == "f":
        return f"case {st} when 0 then '' when 1 then 'N/A' when 2 then concat('-', {n}, '.25') else concat({n}, '.25') end"
    if rule.kind in "dt":
        odd = "concat(year(d), '-1-1')" if rule.parse_date else "concat('day ', year(d))"
        day = "date_format(date_add(d, j), 'yyyy-MM-dd')"
        if rule.kind == "t":
            day = f"concat({day}, ' 0', k % 10, ':30:00')"
        return f"case {st} when 0 then '' when 1 then 'N/A' when 2 then {odd} else {day} end"
    if rule.kind == "b":
        return f"case {st} when 0 then '' when 1 then 'yes' when 2 then 'TRUE' else if(k % 2 = 0, 'true', 'False') end"
    if rule.kind == "a":
        return (f"case {st} when 0 then null when 1 then 'no list' else "
                f"concat('{{\"list\":[{{\"element\":\"a', {n}, '\"}},{{\"element\":\"b\"}}]}}') end")
    return f"case {st} when 0 then '' when 1 then null else concat('v', {n}) end"


def expected_sql(rule: cf.ColumnRule, j: int) -> str:
    """The typed value of the same column (DuckDB SQL over k, d)."""
    if rule.name in FORMS:
        return FORMS[rule.name] if rule.kind == "s" else f"cast({FORMS[rule.name]} as bigint)"
    n, st = _number(j), _state(j)
    if rule.round_int:
        return f"case {st} when 0 then null when 1 then null when 2 then {n} + 1 else {n} end"
    if rule.kind == "i":
        return f"case when {st} > 2 then {n} end"
    if rule.kind == "f":
        return f"case {st} when 0 then null when 1 then null when 2 then -({n} + 0.25::double) else {n} + 0.25::double end"
    if rule.kind == "d":
        return f"case when {st} > 2 then d + {j} end"
    if rule.kind == "t":
        return f"case when {st} > 2 then cast(d + {j} as timestamp) + to_hours(k % 10) + to_minutes(30) end"
    if rule.kind == "b":
        return f"case {st} when 0 then null when 1 then null when 2 then true else k % 2 = 0 end"
    if rule.kind == "a":
        return f"case when {st} > 1 then ['a' || ({n}), 'b'] end"
    return f"case {st} when 0 then '' when 1 then null else 'v' || ({n}) end"


def raw_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog whose raw sources are the exports (lazy, one row an order).  An order is a few bytes and its export
    a hundred cells, so tasks are cut by rows: by bytes a file of a million orders would be one task."""
    cat = test_catalog(spark, sf_dir)
    orders = cat.scan("orders")
    base = orders.select(F.col("o_orderkey").cast("bigint").alias("k"), F.to_date("o_orderdate").alias("d"))
    base = base.repartition(max(1, math.ceil(orders.count() / TASK_ROWS)), "k", "d")
    for model, (source, _) in STAGING_SPECS.items():
        cat.register_frame(source, export(base, model))
    return cat


def export(base: DataFrame, model: str, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Every column as an expression of its own over the row's key and date, with the column's number written in
    (compiled code; a lambda over an array of the columns is interpreted element by element)."""
    return base.select(*keep, *[
        F.expr(FORMS[r.name].replace("varchar(9)", "string") if r.name in FORMS
               else re.sub(r"\bj\b", str(j), form(r))).alias(r.raw)
        for j, r in enumerate(cf.staging_rules(model))])


def staging_sql(model: str, where: str = "true") -> str:
    """DuckDB SQL of a staging model's rows over the exports."""
    cols = ",\n  ".join(f"{expected_sql(r, j)} as {r.name}" for j, r in enumerate(cf.staging_rules(model)))
    return ("select " + cols + "\nfrom (select cast(o_orderkey as bigint) as k, cast(o_orderdate as date) as d "
            f"from orders) where {where}")
