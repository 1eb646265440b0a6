"""Shared plumbing: tables, Arrow mapping, written intermediates."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


ROW_GROUP = 32 << 20          # bytes of a written table's row groups, which a writing task holds
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20         # of a batch sent to a task, where the session has a larger limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, reread: work
    is done once and a lost executor restarts from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array] | None], schema: str) -> DataFrame:
    """Each Arrow batch of ``df`` through ``fn``, which gives the columns of
    ``schema`` in order (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema)
    assert isinstance(schema, (str, StructType))
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(BATCH)) or 0) > BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))

    def run(batches):
        try:
            for batch in batches:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(f.type) if x.type != f.type else x for x, f in zip(out, fields, strict=True)],
                        schema=fields)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Freed memory back to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc
    if trim is not None:
        trim(0)


def bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % n
