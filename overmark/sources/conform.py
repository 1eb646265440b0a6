"""Declarative conform: one generated ``select`` per staging model.

A staging model is an ordered list of column rules; ``conform`` turns it
into a single projection of ``try_cast`` (or the rule's special form), so
Catalyst prunes unused raw columns at the scan and the whole model stays in
one codegen stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import safe
from .specs import DERIVED_MODELS, STAGING_FILTERS, STAGING_SPECS

_TYPES = {"i": "bigint", "f": "double", "s": "string", "d": "date", "t": "timestamp",
          "b": "boolean", "a": "array"}


@dataclass(frozen=True)
class ColumnRule:
    raw: str
    name: str
    kind: str            # one of _TYPES keys
    round_int: bool = False
    strip_plus: bool = False
    na_sentinel: bool = False
    hard: bool = False
    parse_date: bool = False

    @property
    def spark_type(self) -> str:
        return _TYPES[self.kind]


_TOKEN = re.compile(r"^(?P<raw>[A-Za-z0-9_]+)(?:>(?P<name>[a-z0-9_]+))?:(?P<kind>[ifsdtba])(?P<sfx>[rn+!p]*)$")


def parse_spec(spec: str) -> list[ColumnRule]:
    rules = []
    for tok in spec.split():
        m = _TOKEN.match(tok)
        if not m:
            raise ValueError(f"bad column token {tok!r}")
        sfx = m["sfx"]
        rules.append(ColumnRule(raw=m["raw"], name=m["name"] or m["raw"], kind=m["kind"],
                                round_int="r" in sfx, strip_plus="+" in sfx,
                                na_sentinel="n" in sfx, hard="!" in sfx, parse_date="p" in sfx))
    return rules


def rule_expr(rule: ColumnRule, raw_type: T.DataType | None = None) -> Column:
    src = F.col(f"`{rule.raw}`")
    if rule.round_int:
        e = safe.round_cast(src, strip_plus=rule.strip_plus)
    elif rule.na_sentinel:
        e = safe.null_if_sentinel(src.cast("string"), "N/A", rule.spark_type)
    elif rule.parse_date:
        e = safe.parse_date(src.cast("string"))
    elif rule.kind == "a":
        # Parquet LIST of strings read as struct<list: array<struct<element>>>:
        # keep the inner list, as the warehouse model does.  A string-landed
        # cell holds the same structure as JSON.
        if isinstance(raw_type, T.StructType):
            e = src.getField("list")
        elif isinstance(raw_type, T.ArrayType):
            e = src
        else:
            e = F.from_json(src.cast("string"), "list array<struct<element:string>>").getField("list")
    elif rule.hard:
        e = src.cast(rule.spark_type)
    elif rule.kind == "b":
        e = (src.try_cast("boolean") if isinstance(raw_type, (T.BooleanType, T.NumericType))
             else safe.safe_bool(src))
    else:
        e = safe.safe_cast(src, rule.spark_type)
    return e.alias(rule.name)


def conform(df: DataFrame, rules: list[ColumnRule] | str, where: str | Column | None = None,
            optional: tuple[str, ...] = ()) -> DataFrame:
    """Cast, rename and order ``df``'s columns by ``rules``; optional filter.

    Columns are found by name.  A raw column that is absent raises, unless it
    is named in ``optional``; then it is a typed NULL.
    """
    if isinstance(rules, str):
        rules = parse_spec(rules)
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [r.raw for r in rules if r.raw not in present and r.raw not in optional]
    if missing:
        raise ValueError(f"raw columns missing: {missing}")
    cols = []
    for r in rules:
        if r.raw in present:
            cols.append(rule_expr(r, present[r.raw]))
        else:
            t = "array<struct<element:string>>" if r.kind == "a" else r.spark_type
            cols.append(F.lit(None).cast(t).alias(r.name))
    out = df.select(*cols)
    if where is not None:
        out = out.where(where)
    return out


def staging_rules(model: str) -> list[ColumnRule]:
    if model in DERIVED_MODELS:
        model = DERIVED_MODELS[model][0]
    return parse_spec(STAGING_SPECS[model][1])


def conform_model(df: DataFrame, model: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Conform a raw table into the named staging model."""
    base, extra = model, None
    if model in DERIVED_MODELS:
        base, extra = DERIVED_MODELS[model]
    out = conform(df, staging_rules(base), STAGING_FILTERS.get(base), optional)
    return out.where(extra) if extra else out


def raw_string_schema(model: str) -> T.StructType:
    """All-string schema of a model's raw source, for string-first landing;
    array columns land as their JSON text."""
    return T.StructType([T.StructField(r.raw, T.StringType(), True) for r in staging_rules(model)])


def land_strings(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str = "csv", header: bool = True) -> DataFrame:
    """Read exported files with no type guessing: every column a string.

    A CSV with a header is bound by the header's names, in any order; a column
    of ``schema`` that the header lacks raises.  Rows with more or fewer
    fields than the header, and files whose header differs, fail the read.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("inferSchema", False).option("mode", "FAILFAST")
        if header:
            names = spark.read.format("csv").option("header", True).load(path).columns
            missing = [f.name for f in schema.fields if f.name not in names] if schema is not None else []
            if missing:
                raise ValueError(f"columns missing in the header: {missing}")
            own = T.StructType([T.StructField(n, T.StringType()) for n in names])
            landed = reader.option("enforceSchema", False).schema(own).load(path)
            return landed if schema is None else landed.select(*[F.col(f"`{f.name}`") for f in schema.fields])
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


_NON_ALNUM = re.compile(r"[^a-z0-9]+")


def normalize_name(name: str) -> str:
    """Lower-case; '/' and '-' to '_'; other runs of non-alphanumerics to '_';
    strip leading/trailing '_'."""
    s = name.lower().replace("/", "_").replace("-", "_")
    return _NON_ALNUM.sub("_", s).strip("_")


def normalize_columns(df: DataFrame, trim_strings: bool = True) -> DataFrame:
    """Normalise landed column names and trim string cells (one projection)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if trim_strings and isinstance(f.dataType, T.StringType):
            c = F.trim(c)
        cols.append(c.alias(normalize_name(f.name)))
    return df.select(*cols)


def unwrap_list(col: Column | str, field: str = "element") -> Column:
    """``struct<list: array<struct<element>>>`` → ``array<element>``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c.getField("list"), lambda e: e.getField(field))
