"""Queries about candidates without a list, organisations, models and their explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.api import DEMO_TRUTH, demo_vectors
from augury.functions import scores as S
from augury.operators import candidates, consensus, models, org, probs
from augury.plans.register import query, rounded, six
from augury.plans.tables import Tables, consensus_ctes, sql

_TAKEN = "SELECT lower(p_name) AS name FROM part WHERE p_partkey % 5 = 0"
_PROSPECTS = """SELECT p_partkey AS candidate_id, p_name AS name, p_type AS position, round((p_retailprice - 900) / 100, 6) AS production, CASE WHEN p_partkey % 4 <> 0 THEN round(0.95::DOUBLE * round((p_retailprice - 900) / 100, 6), 6) END AS star,
    p_size / 50.0::DOUBLE AS market, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 1 END AS consensus_rank, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 5 ELSE 0 END AS big_board_rank, p_size % 5 AS positional_rank FROM part"""


def _taken(t: Tables) -> DataFrame:
    from augury.functions import text as X

    return t.part.filter("p_partkey % 5 = 0").select(X.normalize(F.col("p_name")).alias("name"))


_KEY = "regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')"


@query(
    f"""WITH p AS ({_PROSPECTS}), s AS (SELECT *, row_number() OVER (ORDER BY consensus_rank NULLS LAST, candidate_id) AS place FROM p),
        o AS (SELECT * FROM s WHERE place <= 200 AND {_KEY} NOT IN (SELECT {_KEY} FROM ({_TAKEN})) ORDER BY place LIMIT 48),
        r AS (SELECT candidate_id, name, position, production AS prospect, coalesce(star, 0.0)::DOUBLE AS star, coalesce(nullif(consensus_rank, 0), nullif(big_board_rank, 0), 40 + place)::BIGINT AS consensus_rank,
              coalesce(nullif(positional_rank, 0), 1)::INT AS best_rank_in_position FROM o)
        SELECT *, row_number() OVER (ORDER BY consensus_rank, candidate_id)::INT AS best_available_rank FROM r"""
)
def default_candidates(t: Tables) -> DataFrame:
    return candidates.default_candidates(t.prospects(), _taken(t), 40)


_LISTS = {
    "ps": f"SELECT * REPLACE (name || ' ' || candidate_id AS name) FROM ({_PROSPECTS})",
    "sc": "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY consensus_rank NULLS LAST, candidate_id)::INT AS place FROM ps) WHERE place <= 200",
    "dr": "SELECT (p_partkey * 7 + p_size * 3) % 97 + 1 AS taken_at, p_partkey AS candidate_id FROM part",
    "le": """SELECT d.slot, sc.*, row_number() OVER (PARTITION BY d.slot ORDER BY place) AS n FROM draft_order d, sc JOIN dr USING (candidate_id) WHERE taken_at >= d.slot""",
    "bl": """SELECT slot, candidate_id, name, position, production AS prospect, coalesce(star, 0.0)::DOUBLE AS star, coalesce(nullif(consensus_rank, 0), nullif(big_board_rank, 0), slot + place)::BIGINT AS consensus_rank,
        coalesce(nullif(positional_rank, 0), 1)::INT AS best_rank_in_position, place FROM le WHERE n <= CASE WHEN slot >= 33 THEN 48 ELSE 24 END""",
    "bb": "SELECT *, row_number() OVER (PARTITION BY slot ORDER BY consensus_rank, place)::INT AS best_available_rank FROM bl",
}


def _lists(t: Tables) -> DataFrame:
    return candidates.board_lists(t.board_prospects(), t.drafted(), t.order())


@query(sql("SELECT * FROM bb", "draft_order", **_LISTS))
def board_aware_candidates(t: Tables) -> DataFrame:
    """The candidates of every slot of the order, without those taken before it."""
    return _lists(t)


@query(
    sql(
        """SELECT slot, team, rank::INT AS rank, candidate_id, round(probability, 6) AS probability, round(gap_best, 6) AS gap_best, round(gap_position, 6) AS gap_position FROM (
             SELECT *, row_number() OVER (PARTITION BY slot, team ORDER BY round(probability, 9) DESC, candidate_id) AS rank FROM (
               SELECT *, greatest(0, least(1, 0.3 * need + 0.3 * prospect + 0.2 * star + 0.15 * greatest(0, 1 - coalesce(consensus_rank, 300) / 300.0::DOUBLE) + 0.025))::DOUBLE AS probability FROM (
                 SELECT bb.*, n_name AS team, coalesce(overall, 0.25)::DOUBLE AS need, (consensus_rank - min(consensus_rank) OVER (PARTITION BY bb.slot))::DOUBLE AS gap_best,
                   (consensus_rank - min(consensus_rank) OVER (PARTITION BY bb.slot, bb.position))::DOUBLE AS gap_position
                 FROM bb CROSS JOIN nation LEFT JOIN needs ON needs.team = n_name AND needs.position = bb.position)))
           WHERE rank <= 5""",
        "draft_order", "needs", **_LISTS,
    )
)
def board_aware_ranking(t: Tables) -> DataFrame:
    """For every slot and every team the five likeliest of the slot's candidates."""
    need = t.needs().select("team", "position", F.col("overall").alias("need"))
    rows = candidates.score(candidates.features_by_slot(_lists(t), need))
    top = candidates.rank_by(rows, "probability", 5, "slot", "team")
    return six(top.select("slot", "team", "rank", "candidate_id", "probability", "gap_best", "gap_position"))


@query(
    f"""WITH p AS ({_PROSPECTS}), s AS (SELECT *, row_number() OVER (ORDER BY consensus_rank NULLS LAST, candidate_id) AS place FROM p)
        SELECT candidate_id, name, position, coalesce(nullif(production, 0), nullif(market, 0), 0.5)::DOUBLE AS prospect, coalesce(nullif(star, 0), 0.5)::DOUBLE AS star, coalesce(nullif(consensus_rank, 0), place)::BIGINT AS consensus_rank,
        coalesce(nullif(positional_rank, 0), 1)::INT AS best_rank_in_position FROM s WHERE place <= 12"""
)
def profile_candidates(t: Tables) -> DataFrame:
    return candidates.profile_candidates(t.prospects())


@query(
    sql(
        """SELECT 3 AS slot, cand AS name, round(weighted_probability, 6) AS prospect, round(weighted_probability, 6) AS star, rank::BIGINT AS consensus_rank FROM c WHERE slot = 3 AND rank <= 5
           UNION ALL SELECT 99, cand, 0.5, 0.5, rn FROM (SELECT cand, row_number() OVER (ORDER BY cand) AS rn FROM (SELECT DISTINCT cand FROM votes)) WHERE rn <= 12""",
        "votes", **consensus_ctes("votes", "c"),
    )
)
def voted_candidates(t: Tables) -> DataFrame:
    """Where there are no prospects: from a slot's consensus, and from all names at a slot without one."""
    votes = t.votes()
    board = consensus.consensus(votes, t.as_of)
    parts = [candidates.voted_candidates(board, votes, slot, 12).select(F.lit(slot).alias("slot"), "*") for slot in (3, 99)]
    return six(parts[0].unionByName(parts[1]))


@query(
    sql(
        """SELECT team, list_sort(list(slot)) AS slots FROM (SELECT DISTINCT team, slot FROM draft_order) GROUP BY team
           UNION ALL SELECT team, list_sort(list(slot)) FROM (SELECT DISTINCT coalesce(team, 'club of ' || source) AS team, slot FROM votes WHERE slot <= 4) WHERE team NOT IN (SELECT team FROM draft_order) GROUP BY team""",
        "votes", "draft_order",
    )
)
def team_slots(t: Tables) -> DataFrame:
    """Votes without a team stand for clubs that the order does not know."""
    votes = t.votes().withColumns({"round": F.when(F.col("slot") <= 4, 1).otherwise(2), "team": F.coalesce("team", F.concat(F.lit("club of "), F.col("source")))})
    return org.slots_of(t.order(), votes)


@query(
    sql(
        """SELECT team, position AS label, round(overall / sum(overall) OVER (PARTITION BY team), 6) AS prob FROM needs JOIN nation ON n_name = team WHERE n_nationkey % 4 <> 0
           UNION ALL SELECT n_name, unnest(['OT', 'EDGE', 'CB', 'WR', 'QB']), 0.2 FROM nation WHERE n_nationkey % 4 = 0""",
        "needs",
    )
)
def fallback_or_uniform(t: Tables) -> DataFrame:
    own = t.needs().join(t.nation.filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("team")), "team", "left_semi")
    return six(probs.from_needs(t.nation.select(F.col("n_name").alias("team")), own.select("team", "position", F.col("overall").alias("need"))))


_OFFICE = {
    "office": "SELECT n_name AS team, n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS manager, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey END AS coach FROM nation WHERE n_nationkey % 6 <> 5",
    "of": """SELECT n.n_name AS team, CASE WHEN manager IS NULL OR k % 3 = 0 THEN 0.5 ELSE coalesce(nullif((k * 17 + 3) % 100, 37) / 100.0::DOUBLE, 0) END AS gm_offense,
        CASE WHEN manager IS NULL OR k % 3 = 0 THEN 0.5 ELSE (k * 31 + 5) % 100 / 100.0::DOUBLE END AS gm_trenches, CASE WHEN manager IS NULL OR k % 3 = 0 THEN 0.5 ELSE (k * 41 + 2) % 100 / 100.0::DOUBLE END AS gm_need,
        CASE WHEN manager IS NULL OR k % 3 = 0 THEN 0.5 ELSE (k * 47 + 6) % 100 / 100.0::DOUBLE END AS gm_bpa, CASE WHEN coach IS NULL OR k % 2 = 0 THEN 0.5 ELSE (k * 61 + 7) % 100 / 100.0::DOUBLE END AS coach_offense,
        CASE WHEN coach IS NULL OR k % 2 = 0 THEN 0.5 ELSE (k * 67 + 10) % 100 / 100.0::DOUBLE END AS coach_trenches,
        CASE WHEN n_nationkey % 4 = 1 THEN 0.5 ELSE coalesce(nullif(n_nationkey * 4 % 100, 0) / 100.0::DOUBLE, 0.5) END AS org_offense, CASE WHEN n_nationkey % 4 = 1 THEN 0.5 ELSE coalesce(nullif(n_nationkey * 8 % 100, 0) / 100.0::DOUBLE, 0.5) END AS org_trenches,
        CASE WHEN n_nationkey % 4 = 1 THEN 0.5 ELSE coalesce(nullif(n_nationkey * 12 % 100, 0) / 100.0::DOUBLE, 0.5) END AS org_need, CASE WHEN n_nationkey % 4 = 1 THEN 0.5 ELSE coalesce(nullif(n_nationkey * 16 % 100, 0) / 100.0::DOUBLE, 0.5) END AS org_bpa,
        CASE WHEN n_nationkey % 4 = 1 THEN 0.5 ELSE coalesce(nullif(n_nationkey * 20 % 100, 0) / 100.0::DOUBLE, 0.5) END AS stability
        FROM nation n LEFT JOIN office ON office.team = n.n_name""",
}


def _chain(t: Tables) -> DataFrame:
    """Nations as teams: some have no office, no manager or coach in it, no history of either, no tendencies, or a tendency of 0."""
    k = F.col("n_nationkey")
    share = lambda a, b=0: (k * a + b) % 100 / 100.0
    year = F.lit(2026).alias("year")
    teams = t.nation.select(F.col("n_name").alias("team"), year)
    office = t.nation.filter("n_nationkey % 6 <> 5").select(F.col("n_name").alias("team"), year, F.when(k % 5 != 0, k).alias("manager_id"), F.when(k % 7 != 0, k).alias("coach_id"))
    people = t.nation.select(k.alias("person_id"))
    managers = t.nation.filter("n_nationkey % 3 <> 0").select(k.alias("person_id"), year, F.nullif(share(17, 3), F.lit(0.37)).alias("offense"), share(31, 5).alias("trenches"), share(41, 2).alias("need_follow"), share(47, 6).alias("bpa"))
    coaches = t.nation.filter("n_nationkey % 2 <> 0").select(k.alias("person_id"), year, share(61, 7).alias("offense"), share(67, 10).alias("trenches"))
    names = ("offense", "trenches", "need_follow", "bpa", "stability")
    tendencies = t.nation.filter("n_nationkey % 4 <> 1").select(F.col("n_name").alias("team"), year, *[share(4 * n).alias(c) for n, c in enumerate(names, 1)])
    return org.features(teams, office, people, managers, people, coaches, tendencies)


_FEATURES = ("gm_offense", "gm_trenches", "gm_need", "gm_bpa", "coach_offense", "coach_trenches", "org_offense", "org_trenches", "org_need", "org_bpa", "stability")


@query(sql(f"SELECT team, 2026 AS year, {rounded(*_FEATURES)} FROM of", **_OFFICE))
def org_features(t: Tables) -> DataFrame:
    return six(_chain(t).select("team", "year", *_FEATURES))


_CAND = """SELECT team, candidate_id, name, position, greatest(0, least(1, 0.3 * coalesce(need, 0.25) + 0.3 * prospect + 0.2 * star + 0.15 * greatest(0, 1 - coalesce(consensus_rank, 300) / 300.0::DOUBLE) + 0.025))::DOUBLE AS probability
    FROM candidates CROSS JOIN (SELECT DISTINCT team FROM needs) LEFT JOIN (SELECT team, position, overall AS need FROM needs) USING (team, position)"""
_C = lambda x: f"greatest(0, least(1, {x}))::DOUBLE"
_RANKED = _OFFICE | {
    "pr": f"SELECT team, offense, {_C('1 - offense')} AS defense, trenches, {_C('1 - trenches')} AS skill, need_follow, bpa, stability FROM (SELECT team, {_C('(gm_offense + coach_offense + org_offense) / 3')} AS offense, {_C('(gm_trenches + coach_trenches + org_trenches) / 3')} AS trenches, {_C('(gm_need + org_need) / 2')} AS need_follow, {_C('(gm_bpa + org_bpa) / 2')} AS bpa, stability FROM of)",
    "ca": _CAND,
    "lab": "SELECT ca.*, ['OT', 'EDGE', 'CB', 'WR', 'QB', 'S'][candidate_id % 6 + 1] AS pos FROM ca",
    "sets": "SELECT * FROM (VALUES ('OT', 1, 0, 1), ('EDGE', 1, 0, 0), ('CB', 0, 1, 0), ('WR', 0, 1, 1), ('QB', 0, 0, 1), ('S', 0, 1, 0)) v(pos, tr, sk, off)",
    "co": f"SELECT lab.*, pr.* EXCLUDE (team), {_C('0.5 + tr * (trenches - 0.5) * 0.9 + sk * (skill - 0.5) * 0.7 + (CASE off WHEN 1 THEN offense ELSE defense END - 0.5) * 0.6 + (need_follow - bpa) * 0.2')} AS component FROM lab JOIN pr USING (team) JOIN sets USING (pos)",
    "aj": "SELECT *, p / sum(p) OVER (PARTITION BY team) AS adjusted FROM (SELECT *, probability * greatest(0, 1 + 0.7 * (component - 0.5)) AS p FROM co)",
    "rk": "SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(adjusted, 9) DESC, candidate_id) AS rank FROM aj",
}


def _ranked(t: Tables) -> DataFrame:
    needs = t.needs().select("team", "position", F.col("overall").alias("need"))
    rows = candidates.score(candidates.features(t.candidates(), needs)).select("team", "candidate_id", "name", "probability")
    labels = F.array(*map(F.lit, ("OT", "EDGE", "CB", "WR", "QB", "S")))
    named = rows.withColumn("position", F.get(labels, (F.col("candidate_id") % 6).cast("int")))
    return org.player_vectors(named, org.priors(_chain(t), ["team"]))


@query(sql(f"SELECT team, candidate_id, pos AS position, rank::INT AS rank, {rounded('probability', 'component')}, round(adjusted, 9) AS adjusted FROM rk WHERE rank <= 12", "needs", "candidates", **_RANKED))
def org_player_ranking(t: Tables) -> DataFrame:
    """All candidates of a team re-weighted by its organisation, the first twelve shown."""
    top = _ranked(t).filter("rank <= 12").select("team", "candidate_id", "position", "rank", "probability", "component", F.round("adjusted", 9).alias("adjusted"))
    return six(top, "adjusted")


@query(
    sql(
        """SELECT team, team || ' enters this pick as a ' || CASE WHEN stability >= 0.6 THEN 'stable regime' ELSE 'transitional regime' END || ' with a ' || CASE WHEN offense >= defense THEN 'offense' ELSE 'defense' END
           || '-leaning, ' || CASE WHEN need_follow >= bpa THEN 'need-aligned' ELSE 'BPA-leaning' END || ' front-office profile. Need and board context surface ' || pos || ', while organizational priors '
           || CASE WHEN component >= 0.62 THEN 'strongly' ELSE 'moderately' END || ' reinforce ' || name || ' as the preferred selection path.' AS explanation FROM rk WHERE rank = 1""",
        "needs", "candidates", **_RANKED,
    )
)
def org_player_explanation(t: Tables) -> DataFrame:
    return org.explained(_ranked(t))


@query(
    """SELECT l_suppkey AS key, round(avg(need), 6) AS need_component, round(avg(best), 6) AS talent_component, round(avg((scarcity + best) / 2), 6) AS context_component, round(avg(signal), 6) AS consensus_signal FROM (
       SELECT l_suppkey, coalesce(nullif(l_discount, 0.05), 0)::DOUBLE AS need, coalesce(nullif(l_tax, 0.02), 0)::DOUBLE AS scarcity, (l_quantity / 50)::DOUBLE AS best,
              CASE WHEN l_linenumber = 7 THEN 0 ELSE greatest(0.0, 1 - l_partkey / 300.0::DOUBLE) END AS signal FROM lineitem) GROUP BY 1"""
)
def grouped_explanations(t: Tables) -> DataFrame:
    parts = S.grouped_explanation(F.nullif("l_discount", F.lit(0.05)), F.nullif("l_tax", F.lit(0.02)), F.col("l_quantity") / 50)
    signal = S.rank_signal(F.when(F.col("l_linenumber") != 7, F.col("l_partkey")))
    return six(t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(*[F.avg(c).alias(n) for n, c in parts.items()], F.avg(signal).alias("consensus_signal")))


@query(
    """SELECT event_type AS family, CASE event_type WHEN 'view' THEN ['team_need', 'roster_continuity', 'age_curve', 'experience_curve'] WHEN 'click' THEN ['team_need', 'pick_context', 'board_context', 'consensus_signals']
       WHEN 'signup' THEN ['team_need', 'prospect_quality', 'superstar_signal', 'rank_gap', 'board_scarcity'] ELSE ['unknown'] END AS feature_groups FROM (SELECT DISTINCT event_type FROM events)"""
)
def feature_groups(t: Tables) -> DataFrame:
    family = F.when(F.col("event_type") == "view", "need_model").when(F.col("event_type") == "click", "position_model").when(F.col("event_type") == "signup", "player_model").otherwise("other")
    return t.events.select("event_type").distinct().select(F.col("event_type").alias("family"), S.feature_groups(family).alias("feature_groups"))


def _demo_sql() -> str:
    rows = ", ".join(f"('{m}', {k}, '{label}', {p!r}::DOUBLE)" for m, vectors in demo_vectors().items() for k, label, p in vectors)
    return f"""WITH d AS (SELECT n_nationkey, n_nationkey % 3 AS k, (n_nationkey // 3) % 3 AS truth FROM nation),
        v AS (SELECT model, n_nationkey, truth, label, p, row_number() OVER (PARTITION BY model, n_nationkey ORDER BY p DESC, label) AS rank FROM (VALUES {rows}) t(model, k, label, p) JOIN d USING (k))
        SELECT model, round(avg(-ln(p)), 6) AS log_loss, avg((rank <= 1)::INT::DOUBLE) AS top1, avg((rank <= 3)::INT::DOUBLE) AS top3 FROM v WHERE label = ['OT', 'QB', 'CB'][truth + 1] GROUP BY model"""


@query(_demo_sql())
def backtest_demo(t: Tables) -> DataFrame:
    """The demonstration's vectors dealt over the nations, each with one of the three labels as its truth."""
    k = F.col("n_nationkey")
    truth = t.nation.select(k.cast("int").alias("row_id"), F.get(F.array(*map(F.lit, DEMO_TRUTH)), F.floor(k / 3).cast("int") % 3).alias("label"))
    rows = t.nation.select(k.cast("int").alias("row_id"), (k % 3).alias("__k"))
    dealt = lambda vectors: rows.join(F.broadcast(t.spark.createDataFrame(vectors, "__k int, label string, prob double")), "__k").drop("__k")
    return six(probs.evaluate({name: dealt(vectors) for name, vectors in demo_vectors().items()}, truth, "row_id"))


@query(
    sql(
        """SELECT n_name AS team, (SELECT coalesce(max(round), 1) FROM (SELECT d.round, count(*) AS n, count(o.slot) AS done FROM draft_order d LEFT JOIN outcomes o ON o.round = d.round AND o.slot = d.slot GROUP BY d.round) r
             WHERE (SELECT count(*) FROM outcomes o WHERE o.round = r.round) >= n)::INT AS latest_completed_round,
           min(d.slot) FILTER (d.slot NOT IN (SELECT slot FROM outcomes)) AS next_slot, min_by(d.round, d.slot) FILTER (d.slot NOT IN (SELECT slot FROM outcomes)) AS next_round
           FROM nation JOIN draft_order d ON d.team = n_name GROUP BY n_name""",
        "outcomes", "draft_order",
    )
)
def team_draft_context(t: Tables) -> DataFrame:
    from augury.api import Board

    return Board({"order": t.order(), "outcomes": t.outcomes()}, t.as_of).draft_context()


def _position_rows(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("top_need_position"), F.col("o_orderstatus").alias("label_position"),
        (F.col("o_totalprice") / 500000).alias("need_score"), F.lit(0.5).alias("board_scarcity_score"), (F.col("o_custkey") % 100 / 100.0).alias("best_available_player_score"),
        (F.col("o_orderkey") % 257 + 1).cast("int").alias("overall_pick"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("round_number"),
    )


@query()
def position_model(t: Tables) -> DataFrame:
    """Trains on orders up to 1999 and gives vectors of later ones."""
    train, _, test = models.split_by_year(_position_rows(t), "year", 1999, 1999)
    return six(models.position_vectors(models.train_position(train), test, ["o_orderkey"]))


@query(
    """SELECT o_orderkey, (SELECT count(DISTINCT substr(o_orderpriority, 1, 1)) FROM orders WHERE year(o_orderdate) <= 1999) AS labels, 1.0::DOUBLE AS total, TRUE AS within, substr(o_orderpriority, 1, 1) AS likeliest FROM orders WHERE year(o_orderdate) > 1999"""
)
def position_model_properties(t: Tables) -> DataFrame:
    """Where the label follows from the top need, every vector has all labels, sums to one, and puts the right one first."""
    rows = _position_rows(t).withColumn("label_position", F.substring("top_need_position", 1, 1))
    train, _, test = models.split_by_year(rows, "year", 1999, 1999)
    out = models.position_vectors(models.train_position(train), test, ["o_orderkey"]).groupBy("o_orderkey")
    return out.agg(F.count(F.lit(1)).alias("labels"), F.round(F.sum("prob"), 6).alias("total"), (F.min("prob").between(0, 1) & F.max("prob").between(0, 1)).alias("within"), F.max_by("label", "prob").alias("likeliest"))


def _player_rows(t: Tables) -> DataFrame:
    needs = t.needs().select("team", "position", F.col("overall").alias("need"))
    rows = candidates.features(t.candidates(), needs).select(
        "team", F.col("name").alias("candidate_player_name"), "candidate_id", "position", F.col("team_need").alias("team_need_score"), F.col("prospect").alias("prospect_score"), F.col("star").alias("superstar_potential_score"),
        F.lit(0.5).alias("positional_scarcity_score"), F.col("consensus_rank").cast("int").alias("consensus_rank"), F.col("gap_best").alias("rank_gap_from_best_available"), F.col("gap_position").alias("rank_gap_within_position"), F.lit(False).alias("selected_label"),
    )
    return models.player_rows(rows)


@query()
def player_model(t: Tables) -> DataFrame:
    """Trains on one class, so with the flipped row, and scores every candidate row."""
    rows = _player_rows(t)
    model = models.train_player(rows)
    return six(models.player_probability(model, rows).select("team", "candidate_id", "probability_selected"))


@query(
    """SELECT count(*) AS rows, TRUE AS within, TRUE AS separates FROM part, nation"""
)
def player_model_properties(t: Tables) -> DataFrame:
    """Where the better half is selected, all probabilities lie in [0, 1] and the mean of the selected is far above the others'."""
    rows = _player_rows(t).withColumn("selected_label", F.col("prospect_score") > 0.5)
    scored = models.player_probability(models.train_player(rows), rows)
    p = F.col("probability_selected")
    mean = lambda yes: F.avg(F.when(F.col("selected_label") == yes, p))
    apart = F.coalesce(mean(True) - mean(False) > 0.5, F.lit(True))
    return scored.agg(F.count(F.lit(1)).alias("rows"), (F.min(p).between(0, 1) & F.max(p).between(0, 1)).alias("within"), apart.alias("separates"))
