"""Probability vectors in long form: row key, label, prob."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import scores as S

# Weights of the default vector; where the top label is one of the four, its entry takes the second.
DEFAULTS = {"OT": (0.2, 0.1), "EDGE": (0.2, 0.1), "CB": (0.15, 0.1), "WR": (0.1, 0.05)}
TOP = 0.45


def normalize(df: DataFrame, key: list[str], value: str = "prob") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*key))
    return df.withColumn(value, F.col(value) / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)))


def default_vector(rows: DataFrame, key: list[str], top: str) -> DataFrame:
    """The default vector around each row's top label; a default label's own, smaller entry replaces the top's."""
    usual = F.array(*[F.struct(F.lit(k).alias("label"), F.when(F.col(top) == k, F.lit(b)).otherwise(a).alias("prob")) for k, (a, b) in DEFAULTS.items()])
    own = F.when(F.col(top).isin(*DEFAULTS), usual).otherwise(F.concat(F.array(F.struct(F.col(top).alias("label"), F.lit(TOP).alias("prob"))), usual))
    return normalize(rows.select(*key, F.explode(own).alias("x")).select(*key, "x.label", "x.prob"), key)


def guard(vectors: DataFrame, needs: DataFrame, key: list[str], floor: float = 0.25, need: float = 0.85, target: float = 0.55) -> DataFrame:
    """Where the needed label (top, top_need) is strong and its probability low, it is set and the others rescaled."""
    w = Window.partitionBy(*key)
    is_top = F.col("label") == F.col("top")
    v = vectors.join(needs, key, "left").withColumn("__own", F.max(F.when(is_top, F.col("prob"))).over(w))
    v = v.withColumns({"__others": F.sum(F.when(is_top, 0.0).otherwise(F.col("prob"))).over(w), "guarded": F.coalesce((F.col("top_need") >= need) & (F.col("__own") < floor), F.lit(False))})
    rest = F.col("prob") / F.coalesce(F.nullif(F.col("__others"), F.lit(0.0)), F.lit(1.0)) * (1 - target)
    return v.withColumn("prob", F.when(~F.col("guarded"), F.col("prob")).when(is_top, target).otherwise(rest)).select(*key, "label", "prob", "guarded")


def reweigh(vectors: DataFrame, factor: Column, key: list[str]) -> DataFrame:
    return normalize(vectors.withColumn("prob", F.greatest(F.lit(0.0), F.col("prob") * factor)), key)


def zip_vectors(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Both vectors over the union of their labels, 0 where one has none."""
    both = a.withColumnRenamed("prob", "a").join(b.withColumnRenamed("prob", "b"), [*key, "label"], "full")
    return both.fillna(0.0, ["a", "b"])


def blend(a: DataFrame, b: DataFrame, key: list[str], alpha: float = 0.45, beta: float = 0.55) -> DataFrame:
    both = zip_vectors(a, b, key).select(*key, "label", (alpha * F.col("a") + beta * F.col("b")).alias("prob"))
    return normalize(both, key)


def decaying(rows: DataFrame, key: list[str], order: list[Column], label: str) -> DataFrame:
    """A vector that falls by a tenth of the first from one rank to the next."""
    index = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return normalize(rows.select(*key, F.col(label).alias("label"), F.greatest(F.lit(0.01), 1 - 0.1 * index).alias("prob")), key)


# The labels of a vector where nothing is known.
UNIFORM = ("OT", "EDGE", "CB", "WR", "QB")


def from_needs(teams: DataFrame, needs: DataFrame) -> DataFrame:
    """team, label, prob of all teams: the needs (team, position, need) as shares; the same for each of UNIFORM where a team has none."""
    own = normalize(needs.select("team", F.col("position").alias("label"), F.col("need").alias("prob")), ["team"])
    bare = teams.select("team").distinct().join(needs.select("team").distinct(), "team", "left_anti")
    same = bare.select("team", F.explode(F.array(*map(F.lit, UNIFORM))).alias("label"), F.lit(1 / len(UNIFORM)).alias("prob"))
    return own.unionByName(same)


def as_map(vectors: DataFrame, key: list[str]) -> DataFrame:
    """key and ranked, an array of (label, prob) by falling probability, ties by label."""
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.round("prob", 9)).alias("o"), "label", "prob")))
    return vectors.groupBy(*key).agg(F.transform(sorted_, lambda x: F.struct(x["label"].alias("label"), x["prob"].alias("prob"))).alias("ranked"))


def evaluate(models: dict[str, DataFrame], truth: DataFrame, key: str) -> DataFrame:
    """Per model: log loss of the truth (key, label) and hit rates of the first and the first three labels."""
    parts = [df.select(F.lit(name).alias("model"), key, "label", "prob") for name, df in models.items()]
    order = Window.partitionBy("model", key).orderBy(F.round("prob", 9).desc(), "label")
    rows = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    names = truth.select(F.explode(F.array(*map(F.lit, models))).alias("model"), key, "label")
    scored = names.join(rows, ["model", key, "label"], "left")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.coalesce("prob", F.lit(1e-12))))
    hit = lambda k: F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double"))
    return scored.groupBy("model").agg(F.avg(-F.log(p)).alias("log_loss"), hit(1).alias("top1"), hit(3).alias("top3"))


def chart_slices(vectors: DataFrame, key: list[str]) -> DataFrame:
    """The slices, and one for the rest where they sum to more than 0.001 and less than 0.98."""
    rest = vectors.groupBy(*key).agg(F.sum("prob").alias("s")).filter("s > 0.001 AND s < 0.98")
    return vectors.select(*key, "label", "prob").unionByName(rest.select(*key, F.lit("other").alias("label"), (1 - F.col("s")).alias("prob")))


def org_adjusted(vectors: DataFrame, priors: DataFrame, key: list[str]) -> DataFrame:
    """Position vectors re-weighted by the priors of the same key."""
    names = ["offense", "defense", "trenches", "skill", "need_follow", "bpa", "stability"]
    rows = vectors.join(priors, key)
    return reweigh(rows, S.position_modifier(F.col("label"), {n: F.col(n) for n in names}), key).select(*key, "label", "prob")
