"""Queries about results that are stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.operators import candidates
from augury.operators.stored import Results, Store, shared_folder
from augury.plans.profiles import _LISTS, _lists
from augury.plans.queries import _SCORED
from augury.plans.register import query, six
from augury.plans.tables import Tables, sql


@query(
    sql(
        """SELECT team, 'v' || v AS version, rank::INT AS rank, candidate_id, round(probability, 6) AS probability, CASE WHEN n_nationkey % 2 = 0 AND v = 1 THEN 1 ELSE 2 END AS call
           FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(probability, 9) DESC, candidate_id) AS rank FROM hp) JOIN nation ON n_name = team, range(1, 3) r(v) WHERE rank <= 5""",
        "needs", "candidates", **_SCORED,
    )
)
def stored_predictions(t: Tables) -> DataFrame:
    """Each team's first five by two versions of a model: half of one version was asked for before, and is read, not computed again."""
    calls: list[int] = []

    def compute(keys: DataFrame) -> DataFrame:
        calls.append(1)
        need = t.needs().select("team", "position", F.col("overall").alias("need")).join(F.broadcast(keys.select("team").distinct()), "team", "left_semi")
        top = candidates.rank_by(candidates.score(candidates.features(t.candidates(), need)), "probability", 5)
        return keys.join(top.select("team", "rank", "candidate_id", "probability"), "team").withColumn("call", F.lit(len(calls)))

    results = Results(Store(t.spark, shared_folder(t.spark, "predictions")), "players", ["team", "version"], by=["version"])
    keys = t.nation.select(F.col("n_name").alias("team"), "n_nationkey", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"))
    results.get(keys.filter("n_nationkey % 2 = 0 AND version = 'v1'"), compute)
    return six(results.get(keys, compute).select("team", "version", "rank", "candidate_id", "probability", "call"))


@query(
    sql(
        """SELECT team, slot, name, rank, call, (SELECT sha256(to_json(list_sort(list({'player_name': name, 'position': position, 'consensus_rank': new_rank})))) FROM ls WHERE ls.changed = tm.changed) AS signature
           FROM tm JOIN (SELECT name, changed, rank FROM ls WHERE rank <= 3) USING (changed)""",
        "candidates",
        tp="SELECT *, row_number() OVER (ORDER BY consensus_rank NULLS LAST, candidate_id)::INT AS rank FROM candidates",
        ls="SELECT name || ' ' || candidate_id AS name, position, rank, consensus_rank + changed::INT AS new_rank, changed FROM tp, (VALUES (false), (true)) v(changed) WHERE rank <= 12",
        tm="SELECT n_name AS team, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey::INT END AS slot, n_nationkey % 3 = 0 AS changed, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS call FROM nation",
    )
)
def signed_views(t: Tables) -> DataFrame:
    """Views of teams, some without a slot, by a digest of their candidates: when a third of the lists change, only those are made anew."""
    calls: list[int] = []
    order = [F.col("consensus_rank").asc_nulls_last(), F.col("candidate_id")]
    top = t.candidates().orderBy(*order).limit(12)
    listed = top.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("consensus_rank", F.lit(1 << 40)).alias("o"), "candidate_id", F.concat_ws(" ", "name", "candidate_id").alias("player_name"), "position", "consensus_rank"))).alias("all"))

    def asked(change: bool) -> DataFrame:
        rows = t.nation.join(F.broadcast(listed), how="cross")  # one row
        moved = F.when(F.lit(change) & (F.col("n_nationkey") % 3 == 0), 1).otherwise(0)
        players = F.transform("all", lambda x: F.struct(x["player_name"].alias("player_name"), x["position"].alias("position"), (x["consensus_rank"] + moved).cast("long").alias("consensus_rank")))
        return rows.select(F.col("n_name").alias("team"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).cast("int").alias("slot"), X.candidate_signature(players).alias("signature"))

    def compute(keys: DataFrame) -> DataFrame:
        calls.append(1)
        rows = keys.join(F.broadcast(listed), how="cross").select("team", "slot", F.posexplode(F.slice("all", 1, 3)).alias("rank", "x"))
        return rows.select("team", "slot", F.col("x.player_name").alias("name"), (F.col("rank") + 1).alias("rank"), F.lit(len(calls)).alias("call"))

    views = Results(Store(t.spark, shared_folder(t.spark, "views")), "views", ["team", "slot"], signature="signature")
    views.get(asked(False), compute)
    rows, now = views.get(asked(True), compute), asked(True)
    named = now.select(F.col("team").alias("__team"), "signature")
    return rows.join(named, F.col("team") == F.col("__team")).drop("__team")


_SLOTTED = _LISTS | {
    "ab": """SELECT d.slot, sc.*, row_number() OVER (PARTITION BY d.slot ORDER BY place) AS n FROM draft_order d, sc""",
    "am": """SELECT slot, candidate_id, position, production AS prospect, coalesce(star, 0.0)::DOUBLE AS star, coalesce(nullif(consensus_rank, 0), nullif(big_board_rank, 0), slot + place)::BIGINT AS consensus_rank
        FROM ab WHERE n <= CASE WHEN slot >= 33 THEN 48 ELSE 24 END""",
    "mx": "SELECT * FROM am WHERE slot % 2 = 1 UNION ALL SELECT slot, candidate_id, position, prospect, star, consensus_rank FROM bb WHERE slot % 2 = 0",
}


@query(
    sql(
        """SELECT 2026 AS year, slot, n_name AS team, candidate_id, round(greatest(0, least(1, 0.3 * coalesce(overall, 0.25) + 0.3 * prospect + 0.2 * star + 0.15 * greatest(0, 1 - coalesce(consensus_rank, 300) / 300.0::DOUBLE) + 0.025))::DOUBLE, 6) AS probability
           FROM mx CROSS JOIN nation LEFT JOIN needs ON needs.team = n_name AND needs.position = mx.position""",
        "draft_order", "needs", **_SLOTTED,
    )
)
def kept_features(t: Tables) -> DataFrame:
    """The features of all slots are stored for an empty board; those of every second slot are then replaced by those of the board as it stands."""
    store = Store(t.spark, shared_folder(t.spark, "features"))
    need = t.needs().select("team", "position", F.col("overall").alias("need"))
    scored = lambda lists: candidates.score(candidates.features_by_slot(lists, need))
    nobody = t.drafted().filter(F.lit(False))
    candidates.keep_features(store, scored(candidates.board_lists(t.board_prospects(), nobody, t.order())), 2026)
    candidates.keep_features(store, scored(_lists(t).filter("slot % 2 = 0")), 2026)
    return six(store.read(candidates.FEATURES).select("year", "slot", "team", "candidate_id", "probability"))


@query(
    sql(
        """SELECT d.team, d.slot, d.round, round(coalesce(f.share, 0), 6) AS board_scarcity_score, round(b.best, 6) AS best_available_player_score, f.position AS top_need_position
           FROM draft_order d LEFT JOIN (SELECT team, position, overall / of AS share FROM (SELECT *, sum(overall) OVER (PARTITION BY team) AS of, row_number() OVER (PARTITION BY team ORDER BY round(overall, 9) DESC, position) AS r FROM needs) WHERE r = 1) f USING (team)
           LEFT JOIN (SELECT slot, max(prospect) AS best FROM bb GROUP BY slot) b USING (slot)""",
        "draft_order", "needs", **_LISTS,
    )
)
def pick_contexts(t: Tables) -> DataFrame:
    """The context of every pick on the board as it stands."""
    need = t.needs().select("team", "position", F.col("overall").alias("need"))
    return six(candidates.pick_context(t.order(), need, _lists(t)))
