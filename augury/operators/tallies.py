"""Votes as sums that can be moved in time and merged.

A vote weighs weight * exp(-age / tau), and its age is counted in whole days. All votes for one
candidate at one slot with one tau and one day are therefore one row, and rows up to some day
are one row of that day: their sum falls by the same factor as time goes on. A consensus at any
later day comes from these rows alone, whose number follows slots and candidates, not votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["slot", "cand", "tau"]
SCHEMA = "slot int, cand string, tau double, day int, n long, w double"


def day_of(published: Column) -> Column:
    """The first midnight at or after a moment, in days: from then on a vote's age is a whole number of days."""
    return F.ceil(F.unix_timestamp(published) / 86400).cast("int")


def daily(votes: DataFrame) -> DataFrame:
    """slot, cand, tau, day, n, w: votes and their undecayed weights summed per day. A weight or tau that is null gives no weight."""
    rows = votes.select("slot", "cand", F.greatest(F.lit(1.0), F.col("tau")).alias("tau"), day_of(F.col("published")).alias("day"), "weight")
    return rows.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def merged(tallies: DataFrame) -> DataFrame:
    """Rows of one key and day as one: what separate batches have tallied."""
    return tallies.groupBy(*KEY, "day").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def moved(w: Column, tau: Column, days: Column) -> Column:
    return w * F.exp(-days / F.greatest(F.lit(1.0), tau))


def compacted(tallies: DataFrame, upto: int) -> DataFrame:
    """All rows up to a day as one row of that day for each key; later rows stay. Exact for a consensus at that day or later."""
    old = F.col("day") <= upto
    rows = tallies.withColumn("w", F.when(old, moved(F.col("w"), F.col("tau"), F.lit(upto) - F.col("day"))).otherwise(F.col("w")))
    return merged(rows.withColumn("day", F.when(old, F.lit(upto)).otherwise(F.col("day"))))


def at(tallies: DataFrame, as_of: Column) -> DataFrame:
    """slot, cand, n, w at a midnight, as consensus.of_tally takes them. Votes from later days count in full, with an age of 0."""
    age = F.greatest(F.lit(0), day_of(as_of) - F.col("day"))
    rows = tallies.withColumn("w", moved(F.col("w"), F.col("tau"), age))
    return rows.groupBy("slot", "cand").agg(F.sum("n").cast("double").alias("n"), F.sum("w").alias("w"))


def open_tallies(tallies: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows whose candidate was not taken at an earlier slot."""
    first = taken.groupBy(F.col("cand").alias("__cand")).agg(F.min("slot").alias("__slot"))
    return tallies.join(first, (F.col("cand") == F.col("__cand")) & (F.col("__slot") < F.col("slot")), "left_anti")

