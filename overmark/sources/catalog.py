"""Logical table names → storage, so models scan by name, not by path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The driver-provided test tables (one parquet file each).
TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


@dataclass
class Catalog:
    """name → (path, format, optional schema).  ``scan`` is lazy: nothing is
    read until an action, and Catalyst prunes columns / pushes filters into
    the Parquet reader."""

    spark: SparkSession
    entries: dict[str, tuple[str, str, T.StructType | None]] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, path: str, fmt: str = "parquet",
                 schema: T.StructType | None = None) -> "Catalog":
        self.entries[name] = (path, fmt, schema)
        return self

    def register_frame(self, name: str, df: DataFrame) -> "Catalog":
        """A name for what another job or reader gives."""
        self.frames[name] = df
        return self

    def scan(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if name not in self.entries:
            # Fall back to a table or view in the session catalog.
            return self.spark.table(name)
        path, fmt, schema = self.entries[name]
        reader = self.spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(path)

    def __getitem__(self, name: str) -> DataFrame:
        return self.scan(name)


def test_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    cat = Catalog(spark)
    for t in TEST_TABLES:
        cat.register(t, f"{sf_dir.rstrip('/')}/{t}.parquet")
    return cat
