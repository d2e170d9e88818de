"""Candidates: candidate_id, name, position, prospect, star, consensus_rank (null if unranked)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.functions import text as X
from augury.operators.consensus import HELD_ROWS, held, ranked
from augury.operators.stored import Store, without

UNRANKED = 300


def best_available(candidates: DataFrame, taken: DataFrame, scan: int = 200, limit: int | None = None) -> DataFrame:
    """The first `scan` by rank, without those taken, renumbered from 1: a top-k, then an anti join."""
    order = [F.col("consensus_rank").asc_nulls_last(), F.col("candidate_id")]
    left = candidates.orderBy(*order).limit(scan).join(taken.select("candidate_id"), "candidate_id", "left_anti")
    out = left.withColumn("best_available_rank", F.row_number().over(Window.orderBy(*order)))  # at most `scan` rows
    return out.filter(F.col("best_available_rank") <= limit) if limit else out


def candidate_limit(slot: Column) -> Column:
    return F.when(slot >= 33, 48).otherwise(24)


def _or(*values: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values[:-1]], values[-1])


def default_candidates(prospects: DataFrame, taken: DataFrame, slot: int, limit: int | None = None, scan: int = 200) -> DataFrame:
    """The candidates of a slot where none are given: the first `scan` prospects by rank, without those taken.

    prospects: candidate_id, name, position, production, star, consensus_rank, big_board_rank,
    positional_rank; taken: name, normalised. A prospect without a rank has its board rank, else its
    place behind the slot. limit is by default that of the slot.
    """
    order = [F.col("consensus_rank").asc_nulls_last(), F.col("candidate_id")]
    top = prospects.orderBy(*order).limit(scan)
    top = top.withColumn("__place", F.row_number().over(Window.orderBy(*order)))  # at most `scan` rows
    key = F.coalesce(F.nullif(X.normalize(F.col("name")), F.lit("")), F.lower(F.trim("name")))
    left = top.withColumn("__key", key).join(F.broadcast(taken.select(F.col("name").alias("__key")).distinct()), "__key", "left_anti")
    first = left.orderBy("__place").limit(limit if limit is not None else (48 if slot >= 33 else 24))
    rows = first.select(
        "candidate_id", "name", "position", F.coalesce("production", F.lit(0.0)).alias("prospect"), F.coalesce("star", F.lit(0.0)).alias("star"),
        _or(F.col("consensus_rank"), F.col("big_board_rank"), F.lit(slot) + F.col("__place")).cast("long").alias("consensus_rank"),
        _or(F.col("positional_rank"), F.lit(1)).cast("int").alias("best_rank_in_position"),
    )
    return rows.withColumn("best_available_rank", F.row_number().over(Window.orderBy("consensus_rank", "candidate_id")))


def board_lists(prospects: DataFrame, taken: DataFrame, slots: DataFrame, given: DataFrame | None = None, limit: int | None = None, scan: int = 200) -> DataFrame:
    """The candidates of every slot: the first ones by rank of `scan` prospects, without those taken at earlier slots.

    A top-k for each slot: the scanned prospects, with the slot at which each was taken, are one row
    that is broadcast; a slot drops from it who was taken before and keeps the first of the rest, as
    many as the slot's limit. A slot for which nobody is left has the list of an empty board.
    taken: slot, name; slots: slot. given (name, position, prospect, star, consensus_rank, in any number
    of rows that one request may hold) replaces the prospects, and then there is no limit. Out come
    slot, the columns of default_candidates, and place, that in the scanned list.
    """
    key = lambda name: F.coalesce(F.nullif(X.normalize(name), F.lit("")), F.lower(F.trim(name)))
    order = [F.col("consensus_rank").asc_nulls_last(), F.col("candidate_id")]
    top = prospects.orderBy(*order).limit(scan)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most `scan` rows
    listed = _one_row(_dated(top.withColumn("__key", key(F.col("name"))), taken, key), "__all")
    rows = slots.select("slot").distinct().join(F.broadcast(listed), how="cross")  # one row
    count = F.lit(limit) if limit is not None else candidate_limit(F.col("slot"))
    free = F.filter("__all", lambda x: x["taken_at"].isNull() | (x["taken_at"] >= F.col("slot")))
    chosen = F.slice(F.when(F.size(free) > 0, free).otherwise(F.col("__all")), F.lit(1), count)
    if given is not None:
        names = ["name", "position", "prospect", "star", "consensus_rank"]
        own = given.select(*[F.col(c) if c in given.columns else F.lit(None).alias(c) for c in ["candidate_id", *names, "positional_rank"]])
        own = own.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # a request's rows
        own = own.select("place", F.col("candidate_id").cast("long"), "name", "position", F.col("prospect").cast("double").alias("production"), F.col("star").cast("double"), F.col("consensus_rank").cast("long"), F.lit(None).cast("long").alias("big_board_rank"), F.col("positional_rank").cast("int"), key(F.col("name")).alias("__key"))
        rows = rows.join(F.broadcast(_one_row(_dated(own, taken, key), "__given")), how="cross")  # one row
        left = F.filter("__given", lambda x: x["taken_at"].isNull() | (x["taken_at"] >= F.col("slot")))
        chosen = F.when(F.size(left) > 0, left).otherwise(F.slice("__all", F.lit(1), count))
    rows = rows.select("slot", F.explode(chosen).alias("x")).select("slot", "x.*")
    rank = _or(F.col("consensus_rank"), F.col("big_board_rank"), F.col("slot") + F.col("place")) if given is None else F.col("consensus_rank")
    rows = rows.select(
        "slot", "candidate_id", "name", "position", F.coalesce("production", F.lit(0.0)).alias("prospect"), F.coalesce("star", F.lit(0.0)).alias("star"),
        rank.cast("long").alias("consensus_rank"), _or(F.col("positional_rank"), F.lit(1)).cast("int").alias("best_rank_in_position"), "place",
    )
    return ranked(rows, ["slot"], [F.col("consensus_rank").asc_nulls_last(), F.col("place")], name="best_available_rank")


def _dated(rows: DataFrame, taken: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """rows with taken_at, the first slot at which their name was taken, null if it wasn't. rows are few, taken may be any number."""
    first = taken.select(key(F.col("name")).alias("__key"), F.col("slot").alias("taken_at")).join(F.broadcast(rows.select("__key").distinct()), "__key", "left_semi")
    first = first.groupBy("__key").agg(F.min("taken_at").alias("taken_at"))  # no more rows than rows has
    return rows.join(F.broadcast(first), "__key", "left")


_LISTED = ["place", "candidate_id", "name", "position", "production", "star", "consensus_rank", "big_board_rank", "positional_rank", "taken_at"]


def _one_row(rows: DataFrame, alias: str) -> DataFrame:
    listed = rows.select(F.col("place"), F.col("candidate_id").cast("long"), "name", "position", F.col("production").cast("double"), F.col("star").cast("double"), F.col("consensus_rank").cast("long"), F.col("big_board_rank").cast("long"), F.col("positional_rank").cast("int"), F.col("taken_at").cast("int"))
    return listed.agg(F.array_sort(F.collect_list(F.struct(*_LISTED))).alias(alias))


def features_by_slot(lists: DataFrame, needs: DataFrame) -> DataFrame:
    """features, with each slot's own list as the candidates: gaps are to the best of the slot, for every team with needs."""
    of_slot, of_position = Window.partitionBy("slot"), Window.partitionBy("slot", "position")
    teams = needs.agg(F.array_sort(F.collect_set("team")).alias("__teams"))
    rows = lists.withColumns({"best": F.min("consensus_rank").over(of_slot), "best_in_position": F.min("consensus_rank").over(of_position)})
    rows = rows.join(F.broadcast(teams), how="cross").withColumn("team", F.explode("__teams"))  # one row
    return _featured(rows.join(needs, ["team", "position"], "left"), "slot", "best_available_rank")


def profile_candidates(prospects: DataFrame, limit: int = 12) -> DataFrame:
    """The first prospects by rank for a team's profile; a score that is null or 0 is the market's, else 0.5."""
    order = [F.col("consensus_rank").asc_nulls_last(), F.col("candidate_id")]
    top = prospects.orderBy(*order).limit(limit).withColumn("__place", F.row_number().over(Window.orderBy(*order)))
    return top.select(
        "candidate_id", "name", "position", _or(F.col("production"), F.col("market"), F.lit(0.5)).alias("prospect"), _or(F.col("star"), F.lit(0.5)).alias("star"),
        _or(F.col("consensus_rank"), F.col("__place")).cast("long").alias("consensus_rank"), _or(F.col("positional_rank"), F.lit(1)).cast("int").alias("best_rank_in_position"),
    )


def voted_candidates(board: DataFrame, votes: DataFrame, slot: int, limit: int) -> DataFrame:
    """Candidates of a slot from its consensus (slot, cand, rank, weighted_probability), else from the names of all votes, in order of name."""
    listed = board.filter(F.col("slot") == slot).select("cand", F.col("weighted_probability").alias("prospect"), F.col("rank").alias("__order"))
    names = votes.select("cand").distinct().orderBy("cand").limit(limit).select("cand", F.lit(0.5).alias("prospect"), F.row_number().over(Window.orderBy("cand")).alias("__order"))
    any_listed = listed.limit(1).select(F.lit(True).alias("__any"))
    rest = names.join(F.broadcast(any_listed), how="left").filter("__any IS NULL").drop("__any")  # one row at most
    rows = listed.unionByName(rest).orderBy("__order").limit(limit)
    return rows.select(F.col("cand").alias("name"), "prospect", F.col("prospect").alias("star"), F.row_number().over(Window.orderBy("__order")).cast("long").alias("consensus_rank"))


#: So many candidates are exploded over the teams in one task.
TASK_CANDIDATES = 25_000


def features(candidates: DataFrame, needs: DataFrame) -> DataFrame:
    """Each candidate for each team with needs (team, position, need): gaps to the best and to the need.

    The teams are an array in a single row that is broadcast, and every candidate is exploded over
    it. A position's facts (its best rank, how many candidates it has, and its needs as an array over teams)
    meet the candidates before that, and the candidates are dealt over tasks by their number, so that
    what a task makes, sorts or keeps is bounded: a scan of a small file is a task or two, whatever comes out of it.
    """
    facts = held(candidates.groupBy("position").agg(F.min("consensus_rank").alias("best_in_position"), F.count(F.lit(1)).alias("__n")))
    total = facts.agg(F.min("best_in_position").alias("best"), F.sum("__n").alias("n"))
    best, n = total.first()
    tasks = -(-(n or 0) // TASK_CANDIDATES)
    if tasks > 1:
        candidates = candidates.repartition(tasks, "candidate_id", "name")
    teams = needs.agg(F.array_sort(F.collect_set("team")).alias("__teams"))
    named = needs.filter("team IS NOT NULL").groupBy("position").agg(F.collect_list(F.struct("team", "need")).alias("__needs"))
    of = facts.drop("__n").join(named, "position", "left")
    of = F.broadcast(of) if facts.count() <= HELD_ROWS else of
    rows = candidates.withColumn("best", F.lit(best)).join(of, "position", "left").join(F.broadcast(teams), how="cross")  # one row
    kind = needs.schema["need"].dataType
    listed = F.coalesce("__needs", F.array().cast(rows.schema["__needs"].dataType))
    others = F.transform(F.array_except("__teams", F.transform(listed, lambda x: x["team"])), lambda x: F.struct(x.alias("team"), F.lit(None).cast(kind).alias("need")))
    return _featured(rows.withColumn("x", F.explode(F.concat(listed, others))).select(*candidates.columns, "best", "best_in_position", "x.team", "x.need"))


def _featured(rows: DataFrame, *more: str) -> DataFrame:
    need = F.coalesce("need", F.lit(0.25))
    rank = F.coalesce(F.nullif("consensus_rank", F.lit(0)), F.lit(UNRANKED)).cast("double")
    return rows.select(
        *more, "team", "candidate_id", "name", "position", "prospect", "star", "consensus_rank",
        need.alias("team_need"),
        (rank - F.coalesce("best", F.lit(UNRANKED))).alias("gap_best"),
        (rank - F.coalesce("best_in_position", F.lit(UNRANKED))).alias("gap_position"),
        F.abs(need - F.col("prospect")).alias("fit_gap"),
        (need - F.col("prospect")).alias("need_vs_bpa"),
    )


def context_features(rows: DataFrame) -> DataFrame:
    """team, slot, round, board_scarcity_score, best_available_player_score, top_need_position of rows of picks' contexts, in the types that the models read."""
    kinds = {"team": "string", "slot": "int", "round": "int", "board_scarcity_score": "double", "best_available_player_score": "double", "top_need_position": "string"}
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def pick_context(order: DataFrame, needs: DataFrame, lists: DataFrame) -> DataFrame:
    """The context of every pick of the order (slot, team, round): the team's top need and its share of all of the team's needs, and the best score on the slot's list.

    needs: team, position, need; lists: those of board_lists. A team without needs has neither, a slot without a list has a score of 0.
    """
    first = needs.groupBy("team").agg(F.min_by(F.struct("position", "need"), F.struct(-F.round("need", 9), F.col("position"))).alias("x"), F.sum("need").alias("of"))
    best = lists.groupBy("slot").agg(F.max("prospect").alias("best_available_player_score"))
    rows = order.select("slot", "team", "round").join(first, "team", "left").join(best, "slot", "left").fillna(0.0, ["best_available_player_score"])
    share = F.coalesce(F.try_divide(F.col("x.need"), F.col("of")), F.lit(0.0))
    return context_features(rows.withColumns({"board_scarcity_score": share, "top_need_position": F.col("x.position")}))


#: A store's table of what candidates were scored by, and what its rows are replaced by.
FEATURES, FEATURES_KEY = "candidate_features", ["year", "slot", "team"]


def keep_features(store: Store, rows: DataFrame, year: int) -> bool:
    """Puts scored rows (of features_by_slot and score) into the store: a year's slot of a team is replaced as a whole, others stay, readers see all of it or nothing."""
    kept = store.staged(rows.select(
        F.lit(year).alias("year"), "slot", "team", F.lit(1).alias("round"), "candidate_id", "name", "position", F.lit(True).alias("available"), "best_available_rank",
        "team_need", "prospect", "star", "consensus_rank", "gap_best", "gap_position", "fit_gap", "need_vs_bpa", "probability",
    ))

    def make(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if FEATURES not in tables:
            return {FEATURES: kept}
        return {FEATURES: without(tables[FEATURES], kept.select(*FEATURES_KEY).distinct(), FEATURES_KEY).unionByName(kept)}

    return store.change(make, by={FEATURES: ["year"]})


def score(rows: DataFrame, scarcity: Column | None = None) -> DataFrame:
    """Heuristic probability, talent, context and override of candidate rows."""
    rank = F.coalesce("consensus_rank", F.lit(UNRANKED)).cast("double")
    p = S.heuristic_candidate(F.col("team_need"), F.col("prospect"), F.col("star"), rank, scarcity if scarcity is not None else F.lit(0.5))
    talent = (F.col("prospect") + F.col("star")) / 2
    rows = rows.withColumns({"probability": p, "talent": talent, "context": 1 - F.least(F.lit(1.0), F.col("gap_best") / 32.0)})
    return rows.withColumn("override", S.override(F.col("team_need"), F.col("talent"), F.col("probability")))


def rank_by(rows: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    return ranked(rows, list(by or ("team",)), [F.round(value, 9).desc(), F.col("candidate_id")], n)


def name_list(rows: DataFrame, by: str, name: str, rank: str, alias: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(rank, name))), lambda x: x[name])
    return rows.groupBy(by).agg(listed.alias(alias))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """Common names, names in one list only, and the Jaccard distance (0 for two empty lists)."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {
        "common": F.array_sort(F.array_intersect(a, b)),
        "only_a": F.size(F.array_except(a, b)),
        "only_b": F.size(F.array_except(b, a)),
        "disagreement": S.clip(F.when(any_ == 0, 0.0).otherwise(1 - both / F.nullif(any_, F.lit(0)))),
    }
