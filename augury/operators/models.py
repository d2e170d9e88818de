"""Position and player classifiers on pyspark.ml, their training rows and registry."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions.scores import feature_groups
from augury.operators import needs
from augury.operators.upserts import replace_partitions

POSITION_NUMBERS = ["need_score", "board_scarcity_score", "best_available_player_score", "overall_pick", "round_number"]
PLAYER_NUMBERS = [
    "team_need_score", "prospect_score", "superstar_potential_score", "positional_scarcity_score", "consensus_rank",
    "rank_gap_from_best_available", "rank_gap_within_position", "fit_gap", "need_vs_bpa_gap",
]


def _pipeline(category: str, numbers: list[str], rows: int, rounds: int, family: str) -> list:
    return [
        StringIndexer(inputCol=category, outputCol="__cat", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol="__cat", outputCol="__hot", dropLast=False),
        VectorAssembler(inputCols=["__hot", *numbers], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=False),
        LogisticRegression(featuresCol="features", labelCol="__label", maxIter=rounds, regParam=1 / max(1, rows), elasticNetParam=0.0, standardization=False, family=family),
    ]


def train_position(rows: DataFrame) -> PipelineModel:
    label = StringIndexer(inputCol="label_position", outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[label, *_pipeline("top_need_position", POSITION_NUMBERS, rows.count(), 600, "multinomial")]).fit(rows)


def position_vectors(model: PipelineModel, rows: DataFrame, key: list[str]) -> DataFrame:
    """Long form: key, label, prob."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    out = PipelineModel(model.stages[1:]).transform(rows).withColumn("__p", vector_to_array("probability"))
    pairs = F.arrays_zip(labels.alias("label"), F.col("__p").alias("prob"))
    return out.select(*key, F.explode(pairs).alias("x")).select(*key, "x.label", "x.prob")


def train_player(rows: DataFrame) -> PipelineModel:
    """With one class only, one flipped copy of the first row by name is added, of rows of one name the first by all columns."""
    seen = rows.agg(F.min("selected_label").alias("lo"), F.max("selected_label").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if seen["lo"] == seen["hi"]:
        first = rows.orderBy("candidate_player_name", *[c for c in rows.columns if c != "candidate_player_name"]).limit(1)
        rows = rows.unionByName(first.withColumn("selected_label", ~F.col("selected_label")))
    rows = rows.withColumn("__label", F.col("selected_label").cast("double"))
    return Pipeline(stages=_pipeline("position", PLAYER_NUMBERS, seen["n"], 800, "binomial")).fit(rows)


def player_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    filled = rows.fillna({"consensus_rank": 300, "position": "UNK"})
    return model.transform(filled).withColumn("probability_selected", F.get(vector_to_array("probability"), F.lit(1))).drop("__cat", "__hot", "__raw", "features", "rawPrediction", "probability", "prediction")


def position_rows(context: DataFrame, needs: DataFrame) -> DataFrame:
    """Training rows: pick context with the need of its position, 0.5 if there is none."""
    out = context.join(needs.select("cycle", "team", F.col("position").alias("top_need_position"), "need"), ["cycle", "team", "top_need_position"], "left")
    return out.withColumn("need_score", F.coalesce("need", F.lit(0.5))).drop("need")


def split_by_year(rows: DataFrame, year: str, train_to: int, validate_to: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    y = F.col(year)
    return rows.filter(y <= train_to), rows.filter((y > train_to) & (y <= validate_to)), rows.filter(y > validate_to)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each family; ties go to the larger id."""
    cols = [c for c in runs.columns if c != "family"]
    return runs.groupBy("family").agg(F.max_by(F.struct(*cols), F.struct("created_at", "run_id")).alias("r")).select("family", "r.*")


#: Columns of the registry of runs.
RUNS = "family string, version string, train_from int, train_to int, validate_from int, validate_to int, test_from int, test_to int, metrics string, path string, created_at timestamp, run_id long"


class Registry:
    """Runs of models in a folder: a table of runs, only ever added to, and one saved model per run that has one."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def runs(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RUNS)

    def add(self, family: str, version: str, windows: tuple[int | None, ...], metrics: dict, model: PipelineModel | None = None) -> str:
        """Records a run (windows: from and to of training, validation, test) and saves its model."""
        run = int(self.runs().agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]) + 1
        path = f"{self.folder}/models/{family}-{run}" if model is not None else ""
        if model is not None:
            model.write().overwrite().save(path)
        row = self.spark.createDataFrame([(family, version, *windows, json.dumps(metrics, sort_keys=True), path, run)], RUNS.replace("created_at timestamp, ", ""))
        row.withColumn("created_at", F.current_timestamp()).select(*[c.split()[0] for c in RUNS.split(", ")]).write.mode("append").parquet(f"{self.folder}/runs")
        return version

    def latest(self) -> DataFrame:
        return latest_run(self.runs())

    def model(self, family: str) -> tuple[PipelineModel, str] | None:
        """The model of the family's newest run and its version; None without one."""
        row = self.latest().filter(F.col("family") == family).select("path", "version").first()
        return (PipelineModel.load(row["path"]), row["version"]) if row and row["path"] else None

    def metadata(self) -> DataFrame:
        """The newest run of each family with its windows, metrics and groups of features."""
        window = lambda k: F.array(f"{k}_from", f"{k}_to").alias(f"{k}_window")
        return self.latest().select("family", "version", window("train"), window("validate"), window("test"), "metrics", feature_groups(F.col("family")).alias("feature_groups"), "created_at")


def need_table(roster: DataFrame) -> DataFrame:
    """The scored needs of a roster of one year, ready to replace that year's partition."""
    return needs.score(needs.need_features(roster))


def player_rows(features: DataFrame) -> DataFrame:
    """Training rows from stored candidate features; gaps that are null are 0."""
    filled = features.fillna(0.0, ["rank_gap_from_best_available", "rank_gap_within_position", "positional_scarcity_score"])
    gap = F.col("team_need_score") - F.col("prospect_score")
    return filled.withColumns({"fit_gap": F.abs(gap), "need_vs_bpa_gap": gap}).fillna({"consensus_rank": 300, "position": "UNK"})


def train_all(registry: Registry, years: list[int], rich_years: list[int], roster: DataFrame, context: DataFrame, needs_of: DataFrame, features: DataFrame, needs_path: str | None = None) -> dict[str, str]:
    """Trains every family up to the newest year that has prospects and needs; version or fault by family.

    A family that fails does not keep the others from being trained. roster and features have a
    column year, context and needs_of a column cycle. needs_path, if given, is a table by year whose
    partition is replaced.
    """
    if not years:
        raise ValueError("there are no years")
    now = max(rich_years or years)
    windows = (min(years), now, now, now, now, now)

    def need() -> str:
        table = need_table(roster.filter(F.col("year") == now))
        if needs_path:
            replace_partitions(table.withColumn("year", F.lit(now)), needs_path, ["year"])
        return registry.add("need_model", f"need-heuristic-v1-{now}", windows, {"scored_positions": table.count()})

    def position() -> str:
        rows = position_rows(context.filter(F.col("cycle").between(min(years), now)), needs_of).filter("label_position IS NOT NULL")
        return registry.add("position_model", f"position-logistic-{now}", windows, {"train_rows": rows.count()}, train_position(rows))

    def player() -> str:
        rows = player_rows(features.filter(F.col("year").between(min(years), now)))
        return registry.add("player_model", f"player-logistic-{now}", windows, {"train_rows": rows.count()}, train_player(rows))

    def plain(family: str, version: str, note: str) -> Callable[[], str]:
        return lambda: registry.add(family, version, (min(years), now, None, None, None, None), {"status": note})

    steps = {
        "need_model": need,
        "position_model": position,
        "player_model": player,
        "org_prior_model": plain("org_prior_model", "org-prior-v1", "heuristic priors"),
        "integrated_team_model": plain("integrated_team_model", "integrated-team-v1", "weighted priors"),
    }
    out = {}
    for family, train in steps.items():
        try:
            out[family] = train()
        except Exception as fault:  # noqa: BLE001  one family's fault is reported, not raised
            out[family] = f"failed: {type(fault).__name__}"
    return out
