"""Catalogue tables from where they are kept: a snapshot store or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.store import SnapshotStore


class StoredTables:
    """The tables of one version of a store, for ``lodeworks.catalogue.Catalogue``; items hold their own peers."""

    def __init__(self, store: SnapshotStore, version: int | None = None):
        self.store, self.version = store, version or store.version()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ("networks", "sites", "works", "people", "bridge", "items", "attempts"):
            raise AttributeError(name)
        return self.store.read(name, self.version)

    @property
    def listed_items(self) -> DataFrame:
        return self.items

    @property
    def peers(self) -> DataFrame:
        return self.items.select("item_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("seeders", "leechers")))


def database_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 16, **options) -> DataFrame:
    """A table over JDBC; with a whole-number ``key`` in as many ranges of it as ``partitions`` says, each read by a task of its own.

    Filters and column choices go to the database. Needs the database's driver on Spark's class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is None:
        return reader.load()
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}) AS low, max({key}) AS high FROM {table}", **options).load().first()
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions)).load()
