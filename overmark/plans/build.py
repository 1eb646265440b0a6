"""The warehouse built into the session catalog: each model in the schema of
its folder, tables as tables, projections as persistent views, descriptions
kept on relations and columns.

    build(Warehouse(catalog), prefix="prod_")
    spark.table("prod_kaggle.nba_kaggle_games")

Models go in the order of their use.  A model that another one reads is read
back through the catalog, so what is written once is not computed again and a
lost executor restarts from the written table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import sinks
from .models import BUILDERS, TABLE_MODELS, Warehouse, parent_of, projection

# The models of the schema ``custom``; the others are told by their names.
CUSTOM = {"stg_nba_custom_betting_final", "nba_betting_final", "elo_teams_mapping", "elo_games_all_time",
          "elo_games_mapping", "elo_series_mapping"}
STORED = TABLE_MODELS | {"stg_nba_elo_teams"}


def schema_of(name: str) -> str:
    """Schema (kaggle, elo, betting, custom) that a model goes to."""
    if name in CUSTOM:
        return "custom"
    for part in ("kaggle", "betting"):
        if f"nba_{part}_" in name:
            return part
    return "elo"


class CatalogWarehouse(Warehouse):
    """``model(name)`` builds the model into the catalog, with what it reads,
    once, and gives the catalog's table or view."""

    def __init__(self, warehouse: Warehouse, prefix: str = "", root: str | None = None,
                 descriptions: dict[str, tuple[str | None, dict[str, str]]] | None = None):
        super().__init__(warehouse.cat)
        self.prefix, self.root, self.descriptions = prefix, root, descriptions or {}
        self.built: dict[str, str] = {}     # model → kind, in build order

    def name_of(self, name: str) -> str:
        return f"{self.prefix}{schema_of(name)}.{name}"

    def model(self, name: str):
        if name in self._built:
            return self._built[name]
        comment, columns = self.descriptions.get(name, (None, {}))
        df = BUILDERS[name](self)           # builds what the model reads first
        spark: SparkSession = df.sparkSession
        unknown = set(columns) - set(df.columns)
        if unknown:
            raise ValueError(f"described columns that {name} lacks: {sorted(unknown)}")
        database, short = self.name_of(name).split(".")
        parent = parent_of(name) if name not in STORED else None
        if parent:
            text = projection(name, self.model(parent).columns)
            sinks.publish_view(spark, database, short, self.name_of(parent), text, comment, columns)
            self.built[name] = "view"
        else:
            # tables, and views whose plans need written intermediates: rows as of this build
            sinks.publish_table(df, database, short, self.root, comment, columns)
            self.built[name] = "table"
        self._built[name] = spark.table(f"`{database}`.`{short}`")
        return self._built[name]

    __getitem__ = model


def build(warehouse: Warehouse, models: list[str] | None = None, prefix: str = "", root: str | None = None,
          descriptions: dict[str, tuple[str | None, dict[str, str]]] | None = None) -> CatalogWarehouse:
    """Build ``models`` (default: all) and what they read; ``built`` of the
    result says what became a table and what a view."""
    out = CatalogWarehouse(warehouse, prefix, root, descriptions)
    for name in models if models is not None else BUILDERS:
        out.model(name)
    return out
