"""Organisations: from the office of a team and year to its people, their features and priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.operators.probs import reweigh


def _people(office: DataFrame, person: str, people: DataFrame, history: DataFrame, values: dict[str, str]) -> DataFrame:
    """team, year and the person's features: neutral for a person without any, null where there is no person."""
    h = history.select(F.col("person_id").alias("__id"), F.col("year").alias("__year"), F.lit(True).alias("__h"), *[F.col(c).alias(f"__{c}") for c in values.values()])
    known = office.select("team", "year", F.col(person).alias("__person")).join(people.select(F.col("person_id").alias("__person"), F.lit(True).alias("__known")), "__person")
    rows = known.join(h, (F.col("__person") == F.col("__id")) & (F.col("year") == F.col("__year")), "left")
    value = lambda c: F.when(F.col("__h").isNull(), 0.5).otherwise(F.coalesce(F.col(f"__{c}").cast("double"), F.lit(0.0)))
    return rows.select("team", "year", *[value(c).alias(name) for name, c in values.items()])


def features(teams: DataFrame, office: DataFrame, managers: DataFrame, manager_history: DataFrame, coaches: DataFrame, coach_history: DataFrame, tendencies: DataFrame) -> DataFrame:
    """One row per team and year of teams: the manager's, the coach's and the organisation's features.

    office: team, year, manager_id, coach_id. History rows: person_id, year and shares. A manager or
    coach without history, and one that is not known, is neutral; an organisation's share that is
    null or 0 is 0.5, and so are all of one without a row.
    """
    manager = _people(office, "manager_id", managers, manager_history, {"gm_offense": "offense", "gm_trenches": "trenches", "gm_need": "need_follow", "gm_bpa": "bpa"})
    coach = _people(office, "coach_id", coaches, coach_history, {"coach_offense": "offense", "coach_trenches": "trenches"})
    shares = {"org_offense": "offense", "org_trenches": "trenches", "org_need": "need_follow", "org_bpa": "bpa", "stability": "stability"}
    own = tendencies.select("team", "year", *[S.or_neutral(F.col(c)).alias(n) for n, c in shares.items()])
    out = teams
    for part in (manager, coach, own):
        out = out.join(part, ["team", "year"], "left")
    return out.fillna(0.5, [c for part in (manager, coach, own) for c in part.columns[2:]])


def priors(rows: DataFrame, key: list[str]) -> DataFrame:
    """The priors of rows of features."""
    return rows.select(*key, *[c.alias(n) for n, c in S.priors({c: F.col(c) for c in rows.columns if c not in key}).items()])


PRIORS = ("offense", "defense", "trenches", "skill", "need_follow", "bpa", "stability")


def player_vectors(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Candidates of a team (team, candidate_id, name, position, probability) re-weighted by its priors.

    New columns: component, adjusted (shares of the team's candidates) and rank, ties by
    best_available_rank if there is one, else by candidate_id.
    """
    both = rows.join(prior, "team").withColumn("component", S.org_component(F.col("position"), {n: F.col(n) for n in PRIORS}))
    both = both.withColumn("prob", F.col("probability"))
    both = reweigh(both, F.greatest(F.lit(0.0), 1 + 0.7 * (F.col("component") - 0.5)), ["team"]).withColumnRenamed("prob", "adjusted")
    tie = "best_available_rank" if "best_available_rank" in rows.columns else "candidate_id"
    order = Window.partitionBy("team").orderBy(F.round("adjusted", 9).desc(), tie)
    return both.withColumn("rank", F.row_number().over(order)).select(*rows.columns, "component", "adjusted", "rank", *PRIORS)


def explained(ranked: DataFrame) -> DataFrame:
    """team and the sentence about its first candidate."""
    p = {n: F.col(n) for n in PRIORS}
    return ranked.filter("rank = 1").select("team", S.explanation(F.col("team"), F.col("position"), F.col("name"), p, F.col("component")).alias("explanation"))


def slots_of(order: DataFrame, votes: DataFrame) -> DataFrame:
    """team and its slots, ascending: those of the order, else those at which early votes see it."""
    own = order.groupBy("team").agg(F.sort_array(F.collect_set("slot")).alias("slots"))
    seen = votes.filter("round = 1 AND team IS NOT NULL").join(order.select("team").distinct(), "team", "left_anti")
    return own.unionByName(seen.groupBy("team").agg(F.sort_array(F.collect_set("slot")).alias("slots")))


def history(votes: DataFrame, teams: DataFrame, year: int, lookback: int = 5) -> DataFrame:
    """team, year, slot, round, position of the picks of the years before `year`, newest year and largest slot first."""
    rows = votes.filter((F.col("year") < year) & (F.col("year") >= year - lookback)).join(teams.select("team").distinct(), "team", "left_semi")
    place = Window.partitionBy("team").orderBy(F.desc("year"), F.desc("slot"), "position")
    return rows.select("team", "year", "slot", "round", "position").withColumn("place", F.row_number().over(place))
