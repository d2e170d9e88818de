"""Tables bucketed on the keys that they are joined on, kept under names in Spark's catalog."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from augury.operators.stored import Files, shared_folder

#: Settings that every session of the engine should have; those of a cluster come on top.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "augury", settings: dict[str, str] | None = None) -> SparkSession:
    """The session in use, or a new one, with SETTINGS and the given ones."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Catalog:
    """Named tables, each bucketed and sorted by one key into the same number of buckets.

    Tables that share a key are joined and grouped on it bucket by bucket, without an exchange: articles with their
    picks, votes with outcomes and candidates. A name is a view of the table that was put last, so readers
    switch from one to the next in one step; the one before is dropped after that.
    """

    def __init__(self, spark: SparkSession, database: str, path: str | None = None, buckets: int = 64):
        self.spark, self.database, self.buckets = spark, database, buckets
        self.path = (path or shared_folder(spark, database)).rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _full(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def put(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Writes rows as the table of a name, one file for each bucket of the key."""
        before = self._tables_of(name)
        table = f"{name}__{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, key).sortBy(key)
        writer.option("path", f"{self.path}/{table}").saveAsTable(self._full(table))
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._full(name)} AS SELECT * FROM {self._full(table)}")
        for old in before:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._full(old)}")
            Files(self.spark, self.path).drop(old)  # dropping the name of an external table leaves its files
        return self.get(name)

    def _tables_of(self, name: str) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(self.database) if t.name.startswith(f"{name}__")]

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self._full(name))

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if "__" not in t.name)

    def tables(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """The tables by name, as a Board takes them."""
        return {n: self.get(n) for n in (names if names is not None else self.names())}

    def drop(self) -> None:
        """Removes the database with all its tables and files."""
        for t in [t.name for t in self.spark.catalog.listTables(self.database)]:
            kind = "TABLE" if "__" in t else "VIEW"
            self.spark.sql(f"DROP {kind} IF EXISTS {self._full(t)}")
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.database}`")
        Files(self.spark, self.path).drop("")
