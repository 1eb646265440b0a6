"""Incremental string-first landing with Structured Streaming.

The warehouse lands raw exports as all-string tables and conforms them in
staging models (batch).  When exports keep arriving as files, the same
landing runs as a streaming query: a file source with the model's
all-string schema (no inference), the staging model's conform projection,
and a Parquet sink whose progress lives in a checkpoint in the shared
folder.  No state is kept (the conform is row-wise), so there is no watermark.

``landing_stream`` has one sink and stops at the first malformed row.
``landing_with_rejects`` has two: rows that fit are conformed, and rows with
more or fewer fields than their header, cells that a hard cast refuses, and
files whose header lacks a column are kept as they came, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import conform as cf


def landing_stream(spark: SparkSession, src_dir: str, model: str, out_dir: str,
                   checkpoint: str, fmt: str = "csv",
                   max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a streaming landing of ``src_dir`` files into ``out_dir`` as the
    conformed staging ``model``.  ``available_now`` processes what is there
    and stops (a scheduled incremental batch); otherwise it runs until
    stopped.

    ``checkpoint`` is the job's own lasting folder: a restart with it lands no
    file again.  CSV files are bound by the names of the header they have when
    the stream starts; a file whose header differs from it fails the batch.
    """
    schema = cf.raw_string_schema(model)
    if fmt == "csv":
        names = spark.read.format("csv").option("header", True).load(src_dir).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    conformed = cf.conform_model(reader.load(src_dir), model)
    writer = (conformed.writeStream.format("parquet").outputMode("append")
              .option("path", out_dir)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


# A field: quoted with doubled quotes inside, or without quotes and commas.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^,"]*+)'


def csv_cells(line: Column) -> tuple[Column, Column]:
    """(raw fields of one CSV line, whether they make up the whole line).  Quoted fields keep their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return raw, F.array_join(raw, ",") == line


def _value(raw: Column) -> Column:
    """A field's text: an empty one is NULL, a quoted empty one is not."""
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), inner).when(raw != "", raw)


def split_rows(lines: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(conformed rows, rejects as file, line, reason) of CSV ``lines`` (file, block, line).

    A file's first line is its header; lines equal to it (parts that were put together) are headers too, and
    empty lines are nothing.  Lines are rejected whole with a reason: ``header: <columns>`` for all lines of a
    file whose header lacks columns of the model or names some twice, ``quotes`` where the quotes do not close,
    ``fields`` where there are more or fewer fields than in the header.  Cells that a safe cast refuses are NULL,
    as in the model, and no reject; rows that the model's filter leaves out are in neither result.
    """
    rules = cf.staging_rules(model)
    wanted = F.array(*[F.lit(r.raw) for r in rules])
    raw, whole = csv_cells(F.col("head"))
    # one row a file: where each column of the model is in that file's header
    heads = (lines.where((F.col("block") == 0) & (F.col("line") != ""))
             .select("file", "line", F.monotonically_increasing_id().alias("at"))
             .groupBy("file").agg(F.min_by("line", "at").alias("head"))
             .select(F.col("file").alias("of"), "head", F.when(whole, F.transform(raw, _value)).alias("names")))
    lacks = F.array_except(wanted, F.coalesce("names", F.array().cast("array<string>")))
    twice = F.array_distinct(F.filter("names", lambda n: F.size(F.filter("names", lambda m: m == n)) > 1))
    odd = F.concat(lacks, F.array_intersect(F.coalesce(twice, F.array().cast("array<string>")), wanted))
    heads = heads.select("of", "head", F.size("names").alias("n"),
                         F.when(F.size(odd) > 0, F.concat(F.lit("header: "), F.array_join(odd, ","))).alias("odd"),
                         F.transform(wanted, lambda w: (F.array_position("names", w) - 1).cast("int")).alias("place"))
    raw, whole = csv_cells(F.col("line"))
    got = (lines.where(F.col("line") != "").join(heads, F.col("file") == F.col("of")).where(F.col("line") != F.col("head"))
           .select("file", "line", "n", "odd", "place", raw.alias("cells"), whole.alias("whole"))
           .withColumn("reason", F.coalesce("odd", F.when(~F.col("whole"), F.lit("quotes"))
                                            .when(F.size("cells") != F.col("n"), F.lit("fields")))))
    good = got.where(F.col("reason").isNull()).select(
        *[_value(F.get("cells", F.get("place", F.lit(i)))).alias(r.raw) for i, r in enumerate(rules)])
    return cf.conform_model(good, model), got.where(F.col("reason").isNotNull()).select("file", "line", "reason")


def landing_with_rejects(spark: SparkSession, src_dir: str, model: str, out_dir: str, rejects_dir: str,
                         checkpoint: str, max_files_per_trigger: int | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Stream the CSV files under ``src_dir`` into two Parquet tables, conformed rows and rejects (``split_rows``).

    Each file is bound by its own header, so columns may come in any order and files may differ.  Fields hold no
    line breaks.  Both tables are dealt by ``batch_id`` and a batch's folders are overwritten, so a batch that is
    run again after a failure replaces what it wrote: every line is in one of the tables, once.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(src_dir).select(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"),
                                        F.col("value").alias("line"))

    def land(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_rows(batch, model)
        good.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")

    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
