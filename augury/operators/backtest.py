"""How well each source's votes met the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions import scores as S


def source_backtest(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per source with votes: hits at the slot, hits of the team, early hits, mean distance (32 if none), score.

    votes: source, slot, cand, team. outcomes: slot, cand, team, id; of several with one slot, or
    one candidate, the largest id counts.
    """
    latest = lambda key: outcomes.groupBy(key).agg(F.max_by(F.struct("slot", "cand", "team"), "id").alias("o"))
    by_slot = latest("slot").select("slot", F.col("o.cand").alias("at_slot"))
    by_cand = latest("cand").select("cand", F.col("o.slot").alias("o_slot"), F.col("o.team").alias("o_team"), F.lit(True).alias("drafted"))
    # Votes that agree in all four are counted before they are joined; sums of whole numbers are exact.
    counted = votes.groupBy("source", "slot", "cand", "team").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(by_slot, "slot", "left").join(by_cand, "cand", "left")
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    away = F.abs(F.col("slot") - F.col("o_slot"))
    out = rows.groupBy("source").agg(
        of(F.col("at_slot") == F.col("cand")).alias("exact_pick_hits"),
        of(F.col("drafted") & (F.col("team") == F.col("o_team"))).alias("player_team_hits"),
        of(F.col("drafted") & (F.col("slot") <= 32)).alias("round1_player_hits"),
        F.coalesce(F.try_divide(F.sum((away * F.col("n")).cast("double")), F.sum(F.when(away.isNotNull(), F.col("n")))), F.lit(32.0)).alias("avg_pick_distance"),
        F.sum("n").alias("n"),
    )
    score = S.accuracy(F.col("exact_pick_hits"), F.col("player_team_hits"), F.col("round1_player_hits"), F.col("avg_pick_distance"), F.col("n"))
    return out.withColumn("weighted_accuracy_score", score).drop("n")
