"""Materialisation: table (written Parquet or a catalog table), view, preview."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def materialize(df: DataFrame, name: str, path: str | None = None,
                partition_by: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame over the written files.

    The write goes to the shared checkpoint folder unless ``path`` is given;
    reading it back cuts the lineage, so later stages restart from the table,
    not from the sources, after a lost executor.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if comment:
        w = w.option("comment", comment)
    w.parquet(path)
    return spark.read.parquet(path)


def save_table(df: DataFrame, name: str, database: str | None = None,
               partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None,
               comment: str | None = None, column_comments: dict[str, str] | None = None) -> str:
    """``saveAsTable`` into a schema (database) — the per-folder routing of
    the warehouse models — with optional table and column descriptions
    (persisted docs).  Bucketing co-locates later joins on the keys.
    Returns the qualified table name."""
    spark = df.sparkSession
    full = f"{database}.{name}" if database else name
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if column_comments:
        fields = []
        for f in df.schema.fields:
            md = dict(f.metadata)
            if f.name in column_comments:
                md["comment"] = column_comments[f.name]
            fields.append(F.col(f"`{f.name}`").alias(f.name, metadata=md))
        df = df.select(*fields)
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    if comment:
        w = w.option("comment", comment)
    w.saveAsTable(full)
    if comment:
        spark.sql(f"COMMENT ON TABLE {full} IS '{_sql_str(comment)}'")
    return full


def _sql_str(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _quoted(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def publish_table(df: DataFrame, database: str, name: str, root: str | None = None, comment: str | None = None,
                  column_comments: dict[str, str] | None = None) -> str:
    """Write ``df`` to a fresh folder and point the catalog table at it.

    Readers see the old rows whole until the write has ended, then the new ones: with an unchanged schema only
    the table's location moves, which the catalog does in one step, so a job that dies while it writes leaves the
    table as it was.  A changed schema needs the table to be made anew.  Files of earlier versions stay under
    ``root`` (default: the shared checkpoint folder), since a running reader may hold them; whoever owns the
    folder ages them out.  Returns the qualified name.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{database}/{name}-{uuid.uuid4().hex}" if root else scratch_path(spark, f"{database}.{name}")
    df.write.option("compression", "snappy").parquet(path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")
    full, notes = _quoted(database, name), column_comments or {}
    kind = _kind(spark, database, name)
    if kind == "VIEW":
        spark.sql(f"DROP VIEW {full}")
    same = kind not in (None, "VIEW") and [(f.name, f.dataType) for f in spark.table(full).schema] == \
        [(f.name, f.dataType) for f in df.schema]
    if same:
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{_sql_str(path)}'")
        for c, text in notes.items():
            spark.sql(f"ALTER TABLE {full} ALTER COLUMN {_quoted(c)} COMMENT '{_sql_str(text)}'")
    else:
        if kind not in (None, "VIEW"):
            spark.sql(f"DROP TABLE {full}")
        cols = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}"
                         + (f" COMMENT '{_sql_str(notes[f.name])}'" if f.name in notes else "") for f in df.schema)
        spark.sql(f"CREATE TABLE {full} ({cols}) USING parquet LOCATION '{_sql_str(path)}'")
    if comment:
        spark.sql(f"COMMENT ON TABLE {full} IS '{_sql_str(comment)}'")
    spark.catalog.refreshTable(full)
    return f"{database}.{name}"


def publish_view(spark: SparkSession, database: str, name: str, parent: str, projection: list[str],
                 comment: str | None = None, column_comments: dict[str, str] | None = None) -> str:
    """A persistent view: ``projection`` (SQL expressions) of the catalog table or view ``parent``.  It holds no
    rows, so it shows what its parent holds when it is read, in any session of the same catalog."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")
    full, notes = _quoted(database, name), column_comments or {}
    if _kind(spark, database, name) not in (None, "VIEW"):
        spark.sql(f"DROP TABLE {full}")
    source = _quoted(*parent.split("."))
    columns = spark.table(source).selectExpr(*projection).columns
    cols = ", ".join(_quoted(c) + (f" COMMENT '{_sql_str(notes[c])}'" if c in notes else "") for c in columns)
    about = f" COMMENT '{_sql_str(comment)}'" if comment else ""
    spark.sql(f"CREATE OR REPLACE VIEW {full} ({cols}){about} AS SELECT {', '.join(projection)} FROM {source}")
    return f"{database}.{name}"


def _kind(spark: SparkSession, database: str, name: str) -> str | None:
    full = f"{_quoted(database, name)}"
    return spark.catalog.getTable(full).tableType if spark.catalog.tableExists(full) else None


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """Bounded preview; give ``order_by`` for a deterministic one."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)

