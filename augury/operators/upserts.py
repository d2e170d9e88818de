"""Idempotent writes as transformations of the old and the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """Of each key the row with the highest version."""
    w = Window.partitionBy(*key).orderBy(*version)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """old with new rows put in by key; of new rows with one key the highest version counts."""
    fresh = keep_latest(new, key, [F.col(version).desc_nulls_last()])
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def unseen(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return new.join(old.select(*key), key, "left_anti")


#: New names are numbered in so many ranges, whose bounds come from a sample of names by hash.
RANGES, SAMPLED = 128, 4096


def get_or_create(dim: DataFrame, names: DataFrame, name: str, ident: str, ranges: int = RANGES) -> DataFrame:
    """dim with a row for every name that it lacks; new ids follow the largest one, in order of name.

    New names are dealt into ranges of about equal size; each is numbered by its place in its range, behind
    the number of names in the ranges before. No task orders more than a range, whatever the names begin with.
    """
    new = unseen(names.select(name).distinct(), dim, [name])
    sample = sorted((r[0] for r in new.filter(F.col(name).isNotNull()).orderBy(F.xxhash64(name), name).limit(SAMPLED).collect()), key=str.encode)
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}, key=str.encode) if sample else []
    at = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col(name)))
    new = new.withColumn("__range", F.coalesce(at, F.lit(-1)))
    sizes = new.groupBy("__range").agg(F.count(F.lit(1)).alias("__of"))  # a row for each range
    before = F.coalesce(F.sum("__of").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = dim.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(name))
    numbered = new.withColumn("__n", place).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").join(F.broadcast(top), how="cross")  # one row
    return dim.select(ident, name).unionByName(numbered.select((F.col("__top") + F.col("__before") + F.col("__n")).alias(ident), name))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def mode(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value per key; ties go to the smallest."""
    n = rows.groupBy(*key, value).count()
    return n.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value), F.max("count").alias("n"))
