"""Weighted consensus of votes per slot, its transpose per candidate, and the live board.

Votes: slot int, cand string, article, source, weight double, tau double, published timestamp,
team string (null if unknown). Everything is computed for all slots or candidates in one job.
Order is total: scores are rounded to nine places before ranking, then the name decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.functions import text as X


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int | None = None, name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col(name) <= top) if top else out


def open_votes(votes: DataFrame, taken: DataFrame) -> DataFrame:
    """Votes whose candidate was not taken at an earlier slot: equality keeps it a hash join."""
    t = taken.select(F.col("cand").alias("__cand"), F.col("slot").alias("__slot"))
    return votes.join(t, (votes["cand"] == t["__cand"]) & (t["__slot"] < votes["slot"]), "left_anti")


HELD_ROWS = 2_000


def held(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame:
    """df as rows in the plan if it has at most so many, so that several uses don't compute it again; else df itself.

    For tables with a row per slot, of which there are a few hundred.
    """
    rows = df.limit(limit + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= limit else df


def excluded(votes: DataFrame, taken: DataFrame) -> DataFrame:
    """Per slot with votes: whether anybody was taken before it, and how many of its votes that leaves out (null if nobody was)."""
    t = taken.groupBy("cand").agg(F.min("slot").alias("__slot"))
    first = t.agg(F.min("__slot").alias("__first"))
    n = votes.groupBy("slot", "cand").agg(F.count(F.lit(1)).alias("n"))  # votes are counted before they are joined
    gone = F.coalesce(F.sum(F.when(F.col("__slot") < F.col("slot"), F.col("n"))), F.lit(0))
    rows = n.join(t, "cand", "left").groupBy("slot").agg(gone.alias("gone")).join(F.broadcast(first), how="cross")  # one row
    aware = F.coalesce(F.col("__first") < F.col("slot"), F.lit(False))
    return rows.select("slot", aware.alias("board_aware"), F.when(aware, F.col("gone")).alias("excluded"))


def tally(votes: DataFrame, as_of: Column) -> DataFrame:
    """Per (slot, cand): rows n and the decayed weight w."""
    aged = S.decay(S.age_days(F.col("published"), as_of), F.col("tau"))
    return votes.groupBy("slot", "cand").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("weight") * aged).alias("w"))


def consensus(votes: DataFrame, as_of: Column, top_n: int = 5) -> DataFrame:
    """slot, rank, cand, probability (of rows), weighted_probability, other_probability, category_count."""
    return of_tally(tally(votes, as_of), top_n)


def of_tally(tallied: DataFrame, top_n: int = 5) -> DataFrame:
    """The consensus of rows of slot, cand, n, w, one for each slot and candidate."""
    slot = Window.partitionBy("slot")
    both = tallied.withColumns({"m": F.count(F.lit(1)).over(slot), "tn": F.sum("n").over(slot), "tw": F.sum("w").over(slot)})
    both = both.withColumn("k", F.greatest(F.col("m") + 1, S.slot_pool(F.col("slot")).cast("long")))
    both = both.withColumns(
        {
            "probability": S.smoothed(F.col("n"), F.col("tn"), F.col("k")),
            "weighted_probability": S.smoothed(F.col("w"), F.col("tw"), F.col("k")),
            "other_probability": S.smoothed_other(F.col("tn"), F.col("m"), F.col("k")),
        }
    )
    order = [F.round("weighted_probability", 9).desc(), F.round("probability", 9).desc(), F.col("cand")]
    out = ranked(both, ["slot"], order, top_n)
    return out.select("slot", "rank", "cand", "probability", "weighted_probability", "other_probability", F.col("k").alias("category_count"))


def confidence(votes: DataFrame) -> DataFrame:
    """Per slot: rows, distinct sources and articles, and whether the evidence is thin."""
    # As in landing: one aggregation by kinds of key.
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    tagged = votes.select("slot", F.explode(F.array(row("all", F.lit(None)), row("source", F.col("source")), row("article", F.col("article")))).alias("x")).select("slot", "x.*")
    counted = tagged.groupBy("slot", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull())
    out = counted.groupBy("slot").agg(F.sum(F.when(F.col("kind") == "all", F.col("n"))).alias("sample_size"), of("source").alias("unique_sources"), of("article").alias("unique_articles"))
    return out.withColumn("low_confidence", (F.col("unique_sources") <= 2) | (F.col("sample_size") <= 4))


def context_rows(votes: DataFrame, slot: int) -> DataFrame:
    """A candidate's votes at the slot if there are any, else all of them."""
    there = F.max((F.col("slot") == slot).cast("int")).over(Window.partitionBy("cand")) == 1
    return votes.withColumn("__there", there).filter((F.col("slot") == slot) | ~F.col("__there")).drop("__there")


def landing(votes: DataFrame, top_n: int = 5) -> DataFrame:
    """Per candidate the likeliest teams. Votes without a team count in sample_size, not in shares."""
    known = F.col("team").isNotNull()
    # A vote as one row of each kind, so that one aggregation with a single exchange gives the totals, the teams, the
    # sources and the articles of a candidate. Totals, teams and sources are summed before it.
    row = lambda kind, key, first=None: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(None).cast("int").alias("first") if first is None else first.cast("int").alias("first"))
    total = row("all", F.lit(None))
    kinds = F.when(known, F.array(total, row("team", F.col("team"), F.col("slot")), row("source", F.col("source")), row("article", F.col("article")))).otherwise(F.array(total))
    tagged = votes.select("cand", F.explode(kinds).alias("x")).select("cand", "x.*")
    counted = tagged.groupBy("cand", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    is_kind = lambda kind: F.col("kind") == kind
    facts = counted.groupBy("cand").agg(
        F.sum(F.when(is_kind("all"), F.col("n"))).alias("sample_size"),
        F.coalesce(F.sum(F.when(is_kind("team"), F.col("n"))), F.lit(0)).alias("known"),
        F.count_if(is_kind("team")).alias("unique_teams"),
        F.count_if(is_kind("source") & F.col("key").isNotNull()).alias("unique_sources"),
        F.count_if(is_kind("article") & F.col("key").isNotNull()).alias("unique_articles"),
        F.coalesce(F.min("first"), F.lit(256)).alias("earliest"),
    )
    # Only teams have a first slot. A filter by kind would be moved below the aggregation, which would then run twice.
    # For the same reason the join is null-safe: a filter for keys that are not null would be moved there as well.
    teams = counted.filter("first IS NOT NULL").select(F.col("cand").alias("__cand"), F.col("key").alias("team"), "n")
    facts = facts.join(teams, F.col("cand").eqNullSafe(F.col("__cand")), "left").drop("__cand")  # a candidate without a known team keeps one row
    k = S.evidence_pool(F.col("unique_teams"), F.col("sample_size"), F.col("unique_sources"), F.col("unique_articles"), F.col("earliest"))
    k = F.greatest(F.col("unique_teams") + 1, k)
    low = (F.col("unique_teams") <= 1) | (F.col("sample_size") <= 4) | (F.col("unique_sources") <= 2)
    facts = facts.withColumns({"category_count": F.when(F.col("known") > 0, k).otherwise(0), "low_confidence": low | (F.col("known") == 0)})
    other = S.smoothed_other(F.col("known").cast("double"), F.col("unique_teams"), F.col("category_count"))
    facts = facts.withColumn("other_probability", F.when(F.col("known") > 0, other).otherwise(1.0))
    out = facts.withColumns(
        {"probability": S.smoothed(F.col("n").cast("double"), F.col("known").cast("double"), F.col("category_count")), "raw_probability": F.col("n") / F.nullif(F.col("known"), F.lit(0))}
    )
    out = ranked(out, ["cand"], [F.round("probability", 9).desc_nulls_last(), F.col("team")], top_n)
    return out.select("cand", "rank", "team", "probability", "raw_probability", "sample_size", "unique_teams", "unique_sources", "unique_articles", "category_count", "other_probability", "low_confidence")


def live_board(votes: DataFrame, outcomes: DataFrame, order: DataFrame, as_of: Column, max_slot: int = 257, listed: int = 8) -> DataFrame:
    """A row per slot: team, round, actual, first of the consensus without those taken before, rank of the actual.

    outcomes: slot, cand, team, round; order: slot, team, round. The rank is 0 if the actual is not listed.
    """
    outcomes = held(outcomes)
    seen = outcomes.select("slot").unionByName(order.select("slot")).filter(F.col("slot") <= max_slot).agg(F.coalesce(F.max("slot"), F.lit(0)).alias("last"))
    length = F.least(F.lit(max_slot), F.greatest(F.lit(32), F.col("last")))
    spine = seen.select(F.explode(F.sequence(F.lit(1), length)).alias("slot"))
    board = consensus(open_votes(votes, outcomes), as_of, listed)
    o = outcomes.select("slot", F.col("cand").alias("actual"), F.col("team").alias("o_team"), F.col("round").alias("o_round"))
    d = order.select("slot", F.col("team").alias("d_team"), F.col("round").alias("d_round"))
    first = F.col("rank") == 1
    seen_at = board.join(o.select("slot", "actual"), "slot", "left").groupBy("slot").agg(
        F.max(F.when(first, F.col("cand"))).alias("consensus_top1"),
        F.max(F.when(first, F.col("weighted_probability"))).alias("consensus_top1_probability"),
        F.max(F.when(F.col("cand") == F.col("actual"), F.col("rank"))).alias("hit"),
    )
    out = spine.join(o, "slot", "left").join(d, "slot", "left").join(seen_at, "slot", "left")
    use_order = F.col("o_team").isNull() & F.col("d_team").isNotNull()
    return out.select(
        "slot",
        F.when(use_order, F.col("d_round")).otherwise(F.coalesce("o_round", F.lit(1))).alias("round"),
        F.coalesce("o_team", "d_team").alias("team"),
        "actual",
        "consensus_top1",
        "consensus_top1_probability",
        F.when(F.col("actual").isNotNull(), F.coalesce("hit", F.lit(0))).alias("rank_of_actual"),
    )


def accuracy(board: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Of the board's slots with an actual and a team: how many, and how often the actual is first or listed.

    listed (slot, cand, rank), if given, is a model's list, with its rates of first and of first five
    beside the consensus'. Slots whose actual has no name count, as misses.
    """
    rows = board.filter("actual IS NOT NULL AND team IS NOT NULL").withColumn("key", X.name_key(F.col("actual")))
    if listed is not None:
        model = listed.groupBy("slot", X.name_key(F.col("cand")).alias("key")).agg(F.min("rank").alias("model_rank"))
        rows = rows.join(model, ["slot", "key"], "left")
    named = F.col("key") != ""
    rate = lambda hit: F.avg(F.coalesce(named & hit, F.lit(False)).cast("double"))
    rates = {"top1_rate": F.col("rank_of_actual") == 1, "top8_rate": F.col("rank_of_actual") > 0}
    if listed is not None:
        rates |= {"model_top1_rate": F.col("model_rank") == 1, "model_top5_rate": F.col("model_rank") <= 5}
    return rows.agg(F.count(F.lit(1)).alias("announced"), *[rate(hit).alias(n) for n, hit in rates.items()])


def round_report(board: DataFrame) -> DataFrame:
    """The newest round with an actual: share of first ranks, slot of the biggest reach, slot of the best value.

    The biggest reach is the first slot whose actual is not listed, else the first with rank 5 or later.
    """
    rows = board.filter("actual IS NOT NULL")
    last = rows.agg(F.max("round").alias("round"))
    rows = rows.join(F.broadcast(last), "round")  # one row
    rank = F.col("rank_of_actual")
    reach = F.coalesce(F.min(F.when(rank == 0, F.col("slot"))), F.min(F.when(rank >= 5, F.col("slot"))))
    value = F.min_by("slot", F.when(rank > 0, F.struct(rank, F.col("slot"))))
    return rows.agg(F.avg((rank == 1).cast("double")).alias("hit_rate"), reach.alias("biggest_reach"), value.alias("best_value"))


def upcoming(order: DataFrame, outcomes: DataFrame, n: int = 4) -> DataFrame:
    """The order's next `n` slots after the last one with an actual."""
    last = outcomes.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("__last"))
    return order.join(F.broadcast(last), how="cross").filter(F.col("slot") > F.col("__last")).drop("__last").orderBy("slot").limit(n)  # one row


def movement(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two snapshots."""
    both = before.select(key, F.col(value).alias("old")).join(now.select(key, F.col(value).alias("new")), key)
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def ladder(board: DataFrame) -> DataFrame:
    """Greedy walk in slot order: the best candidate not used yet, else the best one.

    Each slot depends on all before it, so this is one fold over an array of the slots' short
    lists: at most a few hundred slots, whatever the number of votes.
    """
    per_slot = board.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "cand"))).alias("list"))
    slots = per_slot.groupBy().agg(F.array_sort(F.collect_list(F.struct("slot", "list"))).alias("slots"))
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        free = F.filter(s["list"], lambda x: ~F.array_contains(done, x["cand"]))
        return F.concat(done, F.array(F.coalesce(F.get(free, F.lit(0))["cand"], F.get(s["list"], F.lit(0))["cand"])))

    walked = slots.select("slots", F.aggregate("slots", empty, step).alias("picks"))
    return walked.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), F.col("picks").alias("cand"))).alias("x")).select("x.slot", "x.cand")
