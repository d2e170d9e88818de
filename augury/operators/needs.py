"""Needs of a team from roster rows: team, position, snaps, starts, age, experience, starter, injured."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.operators.consensus import ranked


def need_features(roster: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))  # noqa: E731  null flags leave the mean
    return roster.groupBy("team", "position").agg(
        F.count(F.lit(1)).cast("double").alias("depth_count"),
        F.sum("snaps").cast("double").alias("returning_snaps"),
        F.sum("starts").cast("double").alias("returning_starts"),
        share("age").alias("avg_age"),
        share("experience").alias("avg_experience"),
        share("starter").alias("starter_continuity"),
        share("injured").alias("injury_burden"),
    )


def score(features: DataFrame) -> DataFrame:
    c = F.col
    made = S.need_scores(c("returning_snaps"), c("returning_starts"), c("avg_age"), c("avg_experience"), c("depth_count"), c("starter_continuity"), c("injury_burden"))
    return features.select("team", "position", *[v.alias(k) for k, v in made.items()])


def strength(roster: DataFrame) -> DataFrame:
    rows = roster.groupBy("team", F.upper("position").alias("position")).agg(F.sum("snaps").cast("double").alias("snaps"))
    return rows.select("team", "position", S.clip(F.col("snaps") / S.capacity(F.col("position"))).alias("strength"))


def adjusted(needs: DataFrame, roster: DataFrame) -> DataFrame:
    """needs (team, position, overall) dampened by strength; as they are if there is no roster at all."""
    any_row = roster.limit(1).select(F.lit(True).alias("__any"))
    out = needs.join(strength(roster), ["team", "position"], "left").join(F.broadcast(any_row), how="left")  # one row at most
    value = F.when(F.col("__any"), S.dampened_need(F.col("overall"), F.coalesce("strength", F.lit(0.0)))).otherwise(F.col("overall"))
    return out.select("team", "position", "overall", F.coalesce("strength", F.lit(0.0)).alias("strength"), value.alias("adjusted"))


def top_needs(needs: DataFrame, value: str = "adjusted", n: int = 3) -> DataFrame:
    return ranked(needs, ["team"], [F.round(value, 9).desc(), F.col("position")], n)


def top_position(needs: DataFrame, value: str = "adjusted") -> DataFrame:
    """Each team's greatest need; ties go to the first position in order."""
    first = F.min_by(F.struct("position", value), F.struct(-F.round(value, 9), F.col("position")))
    return needs.groupBy("team").agg(first.alias("x")).select("team", F.col("x.position").alias("top_position"), F.col(f"x.{value}").alias("top_need"))


def scarcity(needs: DataFrame, value: str = "adjusted") -> DataFrame:
    return needs.withColumn("share", F.col(value) / F.coalesce(F.nullif(F.sum(value).over(Window.partitionBy("team")), F.lit(0.0)), F.lit(1.0)))
