"""The registered queries of the domain operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.functions import text as X
from augury.functions.teams import team_aliases
from augury.operators import backtest, candidates, consensus, models, needs, probs, tallies, upserts
from augury.plans.register import ORACLES, QUERIES, query, rounded, six
from augury.plans.tables import Tables, consensus_ctes, sql
from augury.sources import records

_PS = rounded("probability", "weighted_probability", "other_probability")
_TOP = f"SELECT slot, rank::INT AS rank, cand, {_PS}, category_count::BIGINT AS category_count FROM c WHERE rank <= 5"


@query(sql(_TOP, "votes", **consensus_ctes("votes", "c")))
def consensus_topn(t: Tables) -> DataFrame:
    return six(consensus.consensus(t.votes(), t.as_of))


@query(sql(_TOP, "votes", "outcomes", "open_votes", **consensus_ctes("open_votes", "c")))
def consensus_board_aware(t: Tables) -> DataFrame:
    return six(consensus.consensus(consensus.open_votes(t.votes(), t.outcomes()), t.as_of))


@query(
    sql(
        """SELECT slot, count(*) AS sample_size, count(DISTINCT source) AS unique_sources, count(DISTINCT article) AS unique_articles,
           count(DISTINCT source) <= 2 OR count(*) <= 4 AS low_confidence FROM votes GROUP BY slot""",
        "votes",
    )
)
def consensus_confidence(t: Tables) -> DataFrame:
    return consensus.confidence(t.votes())


_EARLIER = "1999-06-01"


@query(sql(_TOP, "votes", **consensus_ctes("votes", "c")))
def consensus_of_tallies(t: Tables) -> DataFrame:
    """The consensus from tallies: days up to an earlier one are one row, the later ones come on top."""
    votes, earlier = t.votes(), F.lit(_EARLIER).cast("timestamp_ntz")
    upto = (date.fromisoformat(_EARLIER) - date(1970, 1, 1)).days
    state = tallies.compacted(tallies.daily(votes.filter(F.col("published") <= earlier)), upto)
    return six(consensus.of_tally(tallies.at(state.unionByName(tallies.daily(votes.filter(F.col("published") > earlier))), t.as_of)))


def _landing_sql(source: str, *names: str, **more: str) -> str:
    k1 = """CASE WHEN sample_size <= 4 THEN greatest(m + 1, least(32, 4 + 30 // (sample_size + 2)))
        WHEN sample_size <= 6 THEN greatest(m + 1, least(10, 3 + 20 // (sample_size + 2)))
        ELSE least(32, greatest(m + 1, CASE WHEN src >= 3 THEN m + 1 WHEN src = 2 AND sample_size >= 10 THEN greatest(m + 1, least(k3, m + 2)) ELSE k3 END)) END"""
    return sql(
        f"""SELECT cand, rank::INT AS rank, team, {rounded("probability", "raw_probability")}, sample_size, m AS unique_teams, src AS unique_sources, arts AS unique_articles,
            CASE WHEN known > 0 THEN k ELSE 0 END::BIGINT AS category_count,
            round(CASE WHEN known > 0 THEN 0.5 * (k - m) / (known + 0.5 * k) ELSE 1.0 END, 6) AS other_probability,
            m <= 1 OR sample_size <= 4 OR src <= 2 AS low_confidence
            FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY round(probability, 9) DESC NULLS LAST, team) AS rank FROM (
              SELECT f.*, team, (n + 0.5) / (known + 0.5 * k) AS probability, n / nullif(known, 0)::DOUBLE AS raw_probability FROM f4 f LEFT JOIN tm USING (cand)))
            WHERE rank <= 5""",
        *names,
        **more,
        f0=f"""SELECT cand, count(*) AS sample_size, count(team) AS known, count(DISTINCT team) AS m, count(DISTINCT CASE WHEN team IS NOT NULL THEN source END) AS src,
            count(DISTINCT CASE WHEN team IS NOT NULL THEN article END) AS arts, least(256, greatest(1, coalesce(min(CASE WHEN team IS NOT NULL THEN slot END), 256))) AS ep
            FROM {source} GROUP BY cand""",
        f1="SELECT *, 2 + greatest(0, least(6, 28 // (sample_size + 2))) AS k0 FROM f0",
        f2="SELECT *, CASE WHEN src <= 1 THEN greatest(m + 1, k0 - 1) ELSE k0 END AS k1 FROM f1",
        f3="SELECT *, CASE WHEN arts >= 8 THEN greatest(m + 1, k1 - 1) ELSE k1 END AS k2 FROM f2",
        f35="SELECT *, CASE WHEN (ep <= 6 AND sample_size >= 6) OR (ep <= 12 AND sample_size >= 10) THEN greatest(m + 1, k2 - 1) ELSE k2 END AS k3 FROM f3",
        f4=f"SELECT *, greatest(m + 1, CASE WHEN m >= 2 THEN greatest(m + 1, least(24, m + 1 + greatest(0, 8 - sample_size // 4))) ELSE {k1} END) AS k FROM f35",
        tm=f"SELECT cand, team, count(*) AS n FROM {source} WHERE team IS NOT NULL GROUP BY 1, 2",
    )


@query(_landing_sql("votes", "votes"))
def landing_spots(t: Tables) -> DataFrame:
    return six(consensus.landing(t.votes()))


@query(_landing_sql("ctx", "votes", ctx="SELECT * FROM votes v WHERE slot = 3 OR NOT EXISTS (SELECT 1 FROM votes w WHERE w.cand = v.cand AND w.slot = 3)"))
def landing_context(t: Tables) -> DataFrame:
    return six(consensus.landing(consensus.context_rows(t.votes(), 3)))


@query(
    sql(
        """SELECT s::INT AS slot, CASE WHEN o.team IS NULL AND d.team IS NOT NULL THEN d.round ELSE coalesce(o.round, 1) END::INT AS round, coalesce(o.team, d.team) AS team,
           o.cand AS actual, t.cand AS consensus_top1, round(t.weighted_probability, 6) AS consensus_top1_probability,
           CASE WHEN o.cand IS NOT NULL THEN coalesce(h.rank, 0) END::INT AS rank_of_actual
           FROM range(1, (SELECT least(257, greatest(32, (SELECT max(slot) FROM (SELECT slot FROM outcomes UNION ALL SELECT slot FROM draft_order))))) + 1) r(s)
           LEFT JOIN outcomes o ON o.slot = s LEFT JOIN draft_order d ON d.slot = s LEFT JOIN c t ON t.slot = s AND t.rank = 1
           LEFT JOIN c h ON h.slot = s AND h.cand = o.cand AND h.rank <= 8""",
        "votes", "outcomes", "draft_order", "open_votes", **consensus_ctes("open_votes", "c"),
    )
)
def live_board(t: Tables) -> DataFrame:
    return six(consensus.live_board(t.votes(), t.outcomes(), t.order(), t.as_of))


@query(
    sql(
        """SELECT team, coalesce(min(slot) FILTER (open AND slot <= 32), min(slot)) AS next_slot, min(slot) FILTER (open AND slot <= 32) IS NOT NULL AS is_open
           FROM (SELECT *, slot NOT IN (SELECT slot FROM outcomes) AS open FROM draft_order) GROUP BY team""",
        "outcomes", "draft_order",
    )
)
def next_open_slot(t: Tables) -> DataFrame:
    order = t.order()
    free = order.filter("slot <= 32").join(t.outcomes().select("slot"), "slot", "left_anti").groupBy("team").agg(F.min("slot").alias("open_slot"))
    out = order.groupBy("team").agg(F.min("slot").alias("first_slot")).join(free, "team", "left")
    return out.select("team", F.coalesce("open_slot", "first_slot").alias("next_slot"), F.col("open_slot").isNotNull().alias("is_open"))


@query(
    sql(
        """SELECT d.round, count(*) AS slots, count(o.slot) AS done, count(o.slot) >= count(*) AS completed,
           least((SELECT max(slot) FROM draft_order), (SELECT coalesce(max(slot), 0) + 1 FROM outcomes))::INT AS on_the_clock,
           CASE WHEN (SELECT count(*) FROM outcomes) = 0 THEN 'pre' WHEN (SELECT count(*) FROM outcomes) >= 257 THEN 'post' ELSE 'live' END AS phase
           FROM draft_order d LEFT JOIN outcomes o USING (slot) GROUP BY d.round""",
        "outcomes", "draft_order",
    )
)
def draft_context(t: Tables) -> DataFrame:
    order, done = t.order(), t.outcomes().select("slot", F.lit(1).alias("done"))
    rounds = order.join(done, "slot", "left").groupBy("round").agg(F.count(F.lit(1)).alias("slots"), F.count("done").alias("done"))
    clock = order.agg(F.max("slot").alias("last")).join(done.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("seen"), F.count(F.lit(1)).alias("total")), how="cross")
    phase = F.when(F.col("total") == 0, "pre").when(F.col("total") >= 257, "post").otherwise("live")
    return rounds.join(F.broadcast(clock), how="cross").select("round", "slots", "done", (F.col("done") >= F.col("slots")).alias("completed"), F.least(F.col("last"), F.col("seen") + 1).alias("on_the_clock"), phase.alias("phase"))


@query(
    sql(
        "SELECT a.slot, a.cand AS old, b.cand AS new FROM c a JOIN b USING (slot) WHERE a.rank = 1 AND b.rank = 1 AND a.cand IS DISTINCT FROM b.cand",
        "votes", "outcomes", "open_votes", **consensus_ctes("votes", "c"), **consensus_ctes("open_votes", "b"),
    )
)
def board_movement(t: Tables) -> DataFrame:
    votes = t.votes()
    return consensus.movement(consensus.consensus(votes, t.as_of, 1), consensus.consensus(consensus.open_votes(votes, t.outcomes()), t.as_of, 1), "slot", "cand")


_RANKED = """lb AS (SELECT o.slot, coalesce(o.team, d.team) AS team, CASE WHEN o.team IS NULL AND d.team IS NOT NULL THEN d.round ELSE coalesce(o.round, 1) END AS round, o.cand, coalesce(c.rank, 0) AS rank
    FROM outcomes o LEFT JOIN draft_order d ON d.slot = o.slot LEFT JOIN c ON c.slot = o.slot AND c.cand = o.cand AND c.rank <= 8)"""


@query(
    sql(
        f""", {_RANKED} SELECT count(*) AS announced, round(avg((rank = 1)::INT::DOUBLE), 6) AS top1_rate, round(avg((rank > 0)::INT::DOUBLE), 6) AS top8_rate,
            round(avg((m.mr = 1)::INT::DOUBLE), 6) AS model_top1_rate, round(avg((m.mr <= 5)::INT::DOUBLE), 6) AS model_top5_rate
            FROM (SELECT lb.*, coalesce((SELECT min(v.rn) FROM plain v WHERE v.slot = lb.slot AND v.cand = lb.cand AND v.rn <= 8), 99) AS mr FROM lb WHERE team IS NOT NULL) m""",
        "votes", "outcomes", "draft_order", "open_votes", **consensus_ctes("open_votes", "c"),
        plain="SELECT slot, cand, row_number() OVER (PARTITION BY slot ORDER BY count(*) DESC, cand) AS rn FROM open_votes GROUP BY 1, 2",
    ).replace(")\n, lb", "),\nlb")
)
def live_accuracy(t: Tables) -> DataFrame:
    """The consensus' rates beside those of a plain count of votes, which stands for a model's list."""
    outcomes = consensus.held(t.outcomes())
    board = consensus.live_board(t.votes(), outcomes, t.order(), t.as_of)
    counts = consensus.open_votes(t.votes(), outcomes).groupBy("slot", "cand").agg(F.count(F.lit(1)).alias("n"))
    return six(consensus.accuracy(board, consensus.ranked(counts, ["slot"], [F.desc("n"), F.col("cand")], 8)))


@query(
    sql(
        f""", {_RANKED} SELECT round(avg((rank = 1)::INT::DOUBLE), 6) AS hit_rate, coalesce(min(slot) FILTER (rank = 0), min(slot) FILTER (rank >= 5)) AS biggest_reach,
            min_by(slot, rank * 1000 + slot) FILTER (rank > 0) AS best_value FROM lb WHERE round = (SELECT max(round) FROM lb)""",
        "votes", "outcomes", "draft_order", "open_votes", **consensus_ctes("open_votes", "c"),
    ).replace(")\n, lb", "),\nlb")
)
def round_report(t: Tables) -> DataFrame:
    return six(consensus.round_report(consensus.live_board(t.votes(), t.outcomes(), t.order(), t.as_of)))


@query(
    sql(
        """SELECT v.slot, (SELECT min(slot) FROM outcomes) < v.slot AS board_aware, CASE WHEN (SELECT min(slot) FROM outcomes) < v.slot THEN count(*) FILTER (EXISTS (SELECT 1 FROM outcomes o WHERE o.cand = v.cand AND o.slot < v.slot)) END AS excluded
           FROM votes v GROUP BY v.slot""",
        "votes", "outcomes",
    )
)
def excluded_votes(t: Tables) -> DataFrame:
    return consensus.excluded(t.votes(), t.outcomes())


@query(sql("SELECT slot, team, round FROM draft_order WHERE slot > (SELECT max(slot) FROM outcomes) ORDER BY slot LIMIT 4", "outcomes", "draft_order"))
def upcoming_slots(t: Tables) -> DataFrame:
    return consensus.upcoming(t.order(), t.outcomes())


@query(
    sql(
        """SELECT source, exact_pick_hits, player_team_hits, round1_player_hits, round(d, 6) AS avg_pick_distance,
           round(greatest(0, (4.0 * exact_pick_hits + 2.0 * player_team_hits + round1_player_hits - 0.25 * d) / greatest(1.0, n / 32.0::DOUBLE))::DOUBLE, 6) AS weighted_accuracy_score
           FROM (SELECT source, count(*) AS n, count(*) FILTER (a.cand = v.cand) AS exact_pick_hits, count(*) FILTER (p.team = v.team) AS player_team_hits,
                 count(*) FILTER (p.slot IS NOT NULL AND v.slot <= 32) AS round1_player_hits, coalesce(avg(abs(v.slot - p.slot)), 32.0)::DOUBLE AS d
                 FROM votes v LEFT JOIN outcomes a ON a.slot = v.slot LEFT JOIN p ON p.cand = v.cand GROUP BY source)""",
        "votes", "outcomes", p="SELECT cand, max_by(slot, id) AS slot, arg_max_null(team, id) AS team FROM outcomes GROUP BY cand",
    )
)
def source_backtest(t: Tables) -> DataFrame:
    return six(backtest.source_backtest(t.votes(), t.outcomes()))


_FEATURES = """SELECT team, position, count(*)::DOUBLE AS depth_count, sum(snaps)::DOUBLE AS returning_snaps, sum(starts)::DOUBLE AS returning_starts, coalesce(avg(age), 0) AS avg_age,
    coalesce(avg(experience), 0) AS avg_experience, coalesce(avg(starter::INT), 0)::DOUBLE AS starter_continuity, coalesce(avg(injured::INT), 0)::DOUBLE AS injury_burden FROM roster GROUP BY 1, 2"""


@query(sql(f"SELECT team, position, {rounded('depth_count', 'returning_snaps', 'returning_starts', 'avg_age', 'avg_experience', 'starter_continuity', 'injury_burden')} FROM f", "roster", f=_FEATURES))
def roster_need_features(t: Tables) -> DataFrame:
    return six(needs.need_features(t.roster()))


@query(
    sql(
        f"SELECT team, position, {rounded('snaps_risk', 'starts_risk', 'depth_risk', 'age_risk', 'experience_risk', 'continuity_risk', 'short_term', 'long_term')}, round(greatest(0, least(1, 0.55 * short_term + 0.45 * long_term))::DOUBLE, 6) AS overall FROM m2",
        "roster",
        f=_FEATURES,
        m="""SELECT *, greatest(0, least(1, 1 - returning_snaps / 3500))::DOUBLE AS snaps_risk, greatest(0, least(1, 1 - returning_starts / 85))::DOUBLE AS starts_risk,
            greatest(0, least(1, 1 - depth_count / 6))::DOUBLE AS depth_risk, greatest(0, least(1, (avg_age - 25) / 8))::DOUBLE AS age_risk,
            greatest(0, least(1, 1 - avg_experience / 6))::DOUBLE AS experience_risk, greatest(0, least(1, 1 - starter_continuity))::DOUBLE AS continuity_risk FROM f""",
        m2="""SELECT *, greatest(0, least(1, 0.32 * snaps_risk + 0.24 * starts_risk + 0.18 * continuity_risk + 0.12 * injury_burden + 0.14 * depth_risk))::DOUBLE AS short_term,
            greatest(0, least(1, 0.4 * age_risk + 0.35 * experience_risk + 0.25 * depth_risk))::DOUBLE AS long_term FROM m""",
    )
)
def need_scores(t: Tables) -> DataFrame:
    return six(needs.score(needs.need_features(t.roster())))


_ADJ = {
    "st": "SELECT team, upper(position) AS position, greatest(0, least(1, sum(snaps)::DOUBLE / 1600.0))::DOUBLE AS strength FROM roster GROUP BY 1, 2",
    "adj": """SELECT n.team, n.position, overall, coalesce(strength, 0.0)::DOUBLE AS strength, CASE WHEN coalesce(strength, 0.0) <= 0 THEN greatest(0, least(1, overall))
        ELSE greatest(0.04, least(0.99, overall * greatest(0.08, 1 - 0.72 * strength))) END::DOUBLE AS adjusted FROM needs n LEFT JOIN st USING (team, position)""",
}


def _adjusted(t: Tables) -> DataFrame:
    return needs.adjusted(t.needs(), t.roster())


@query(sql(f"SELECT team, position, {rounded('overall', 'strength', 'adjusted')} FROM adj", "roster", "needs", **_ADJ))
def roster_strength_adjusted_need(t: Tables) -> DataFrame:
    return six(_adjusted(t))


@query(
    sql(
        "SELECT team, position, round(adjusted, 6) AS adjusted, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(adjusted, 9) DESC, position) AS rank FROM adj) WHERE rank <= 3",
        "roster", "needs", **_ADJ,
    )
)
def top_needs(t: Tables) -> DataFrame:
    return six(needs.top_needs(_adjusted(t)).select("team", "position", "adjusted", "rank"))


@query(sql("SELECT team, min_by(position, (-round(overall, 9), position)) AS top_position, round(max(overall), 6) AS top_need FROM needs GROUP BY team", "needs"))
def top_need_position(t: Tables) -> DataFrame:
    return six(needs.top_position(t.needs(), "overall"))


_BEST = {
    "taken": "SELECT candidate_id FROM candidates WHERE candidate_id % 5 = 0",
    "best": """SELECT *, row_number() OVER (ORDER BY consensus_rank NULLS LAST, candidate_id)::INT AS best_available_rank FROM (SELECT * FROM candidates ORDER BY consensus_rank NULLS LAST, candidate_id LIMIT 200)
        WHERE candidate_id NOT IN (SELECT candidate_id FROM taken)""",
}


@query(sql("SELECT * FROM best WHERE best_available_rank <= 48", "candidates", **_BEST))
def best_available_rank(t: Tables) -> DataFrame:
    cand = t.candidates()
    return candidates.best_available(cand, cand.filter("candidate_id % 5 = 0"), 200, 48)


def _need(t: Tables) -> DataFrame:
    return t.needs().select("team", "position", F.col("overall").alias("need"))


_CF = {
    "nd": "SELECT team, position, overall AS need FROM needs",
    "cf": """SELECT team, candidate_id, name, position, prospect, star, consensus_rank, coalesce(need, 0.25)::DOUBLE AS team_need,
        (coalesce(nullif(consensus_rank, 0), 300) - (SELECT min(consensus_rank) FROM candidates))::DOUBLE AS gap_best,
        (coalesce(nullif(consensus_rank, 0), 300) - min(consensus_rank) OVER (PARTITION BY position))::DOUBLE AS gap_position,
        abs(coalesce(need, 0.25) - prospect)::DOUBLE AS fit_gap, (coalesce(need, 0.25) - prospect)::DOUBLE AS need_vs_bpa
        FROM candidates CROSS JOIN (SELECT DISTINCT team FROM nd) LEFT JOIN nd USING (team, position)""",
}
_SCORED = _CF | {
    "hp": "SELECT *, greatest(0, least(1, 0.3 * team_need + 0.3 * prospect + 0.2 * star + 0.15 * greatest(0, 1 - coalesce(consensus_rank, 300) / 300.0::DOUBLE) + 0.025))::DOUBLE AS probability, (prospect + star) / 2 AS talent, (1 - least(1, gap_best / 32))::DOUBLE AS context FROM cf",
    "ov": "SELECT *, greatest(0, least(1, greatest(0, 1 - team_need) * greatest(0, least(1, (talent - 0.65) / 0.35)) * greatest(0, least(1, (probability - 0.2) / 0.8)) * 2.2))::DOUBLE AS override FROM hp",
}


def _rows(t: Tables) -> DataFrame:
    return candidates.features(t.candidates(), _need(t))


@query(sql(f"SELECT team, candidate_id, name, position, {rounded('prospect', 'star', 'team_need', 'gap_best', 'gap_position', 'fit_gap', 'need_vs_bpa')}, consensus_rank FROM cf", "needs", "candidates", **_CF))
def candidate_features(t: Tables) -> DataFrame:
    return six(_rows(t))


@query(sql(f"SELECT team, candidate_id, rank::INT AS rank, {rounded('probability', 'talent', 'context')} FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(probability, 9) DESC, candidate_id) AS rank FROM hp) WHERE rank <= 24", "needs", "candidates", **_SCORED))
def heuristic_player_rank(t: Tables) -> DataFrame:
    top = candidates.rank_by(candidates.score(_rows(t)), "probability", 24)
    return six(top.select("team", "candidate_id", "rank", "probability", "talent", "context"))


@query(sql("SELECT team, candidate_id, round(override, 6) AS override FROM ov", "needs", "candidates", **_SCORED))
def superstar_override(t: Tables) -> DataFrame:
    return six(candidates.score(_rows(t)).select("team", "candidate_id", "override"))


@query(
    sql(
        """SELECT team, list_sort(list_intersect(a, b)) AS common, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS only_b,
           round(1 - len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 6) AS disagreement
           FROM (SELECT team, list(brand) AS a FROM ra WHERE r <= 5 GROUP BY team) JOIN nation ON n_name = team JOIN (SELECT slot, list(cand) AS b FROM c WHERE rank <= 5 GROUP BY slot) ON slot = n_nationkey % 7 + 1""",
        "votes", "needs", "candidates", **_SCORED, **consensus_ctes("votes", "c"),
        ra="""SELECT team, brand, row_number() OVER (PARTITION BY team ORDER BY round(p, 9) DESC, brand) AS r
              FROM (SELECT team, p_brand AS brand, max(probability) AS p FROM hp JOIN part ON p_partkey = candidate_id GROUP BY 1, 2)""",
    )
)
def consensus_vs_model_jaccard(t: Tables) -> DataFrame:
    """Per team the first five brands of its candidates against the consensus of a slot."""
    brands = t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("brand"))
    model = candidates.score(_rows(t)).join(brands, "candidate_id").groupBy("team", "brand").agg(F.max("probability").alias("probability"))
    model = consensus.ranked(model, ["team"], [F.round("probability", 9).desc(), F.col("brand")], 5)
    a = candidates.name_list(model, "team", "brand", "rank", "a")
    b = candidates.name_list(consensus.consensus(t.votes(), t.as_of), "slot", "cand", "rank", "b")
    both = a.join(t.nation, F.col("n_name") == F.col("team")).join(b, F.col("slot") == F.col("n_nationkey") % 7 + 1)
    return six(both.select("team", *[c.alias(n) for n, c in candidates.compare(F.col("a"), F.col("b")).items()]))


_TOPS = "SELECT n_nationkey AS row_id, ['OT', 'EDGE', 'CB', 'WR', 'QB', 'S'][n_nationkey % 6 + 1] AS top, (n_nationkey % 10) / 10.0::DOUBLE + 0.05 AS top_need FROM nation"
_VEC = {
    "tops": _TOPS,
    "d": "SELECT * FROM (VALUES ('OT', 0.2, 0.1), ('EDGE', 0.2, 0.1), ('CB', 0.15, 0.1), ('WR', 0.1, 0.05)) v(label, usual, own)",
    "vec0": "SELECT row_id, label, (CASE WHEN top = label THEN own ELSE usual END)::DOUBLE AS p FROM tops, d UNION ALL SELECT row_id, top, 0.45 FROM tops WHERE top NOT IN (SELECT label FROM d)",
    "vec": "SELECT row_id, label, p / sum(p) OVER (PARTITION BY row_id) AS prob FROM vec0",
    "gd": """SELECT row_id, label, guarded, CASE WHEN NOT guarded THEN prob WHEN label = top THEN 0.55 ELSE prob / others * 0.45 END::DOUBLE AS prob FROM (
        SELECT *, top_need >= 0.85 AND max(CASE WHEN label = top THEN prob END) OVER w < 0.25 AS guarded, sum(CASE WHEN label = top THEN 0 ELSE prob END) OVER w AS others
        FROM vec JOIN tops USING (row_id) WINDOW w AS (PARTITION BY row_id))""",
}


def _tops(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("OT", "EDGE", "CB", "WR", "QB", "S")))
    k = F.col("n_nationkey")
    return t.nation.select(k.alias("row_id"), F.get(names, k % 6).alias("top"), ((k % 10) / 10.0 + 0.05).alias("top_need"))


def _vectors(t: Tables) -> DataFrame:
    return probs.default_vector(_tops(t), ["row_id"], "top")


def _guarded(t: Tables) -> DataFrame:
    return probs.guard(_vectors(t), _tops(t), ["row_id"])


@query(sql("SELECT row_id, label, round(prob, 6) AS prob FROM vec", **_VEC))
def position_vector(t: Tables) -> DataFrame:
    return six(_vectors(t))


@query(sql("SELECT row_id, label, guarded, round(prob, 6) AS prob FROM gd", **_VEC))
def position_guardrail(t: Tables) -> DataFrame:
    return six(_guarded(t))


_C = lambda x: f"greatest(0, least(1, {x}))::DOUBLE"
_PRIORS = {
    "pr": "SELECT team, offense, "
    + _C("1 - offense")
    + " AS defense, trenches, "
    + _C("1 - trenches")
    + " AS skill, need_follow, bpa, stability FROM (SELECT team, "
    + _C("(gm_offense + coalesce(coach_offense, 0.5) + org_offense) / 3")
    + " AS offense, "
    + _C("(gm_trenches + coalesce(coach_trenches, 0.5) + org_trenches) / 3")
    + " AS trenches, "
    + _C("(gm_need + org_need) / 2")
    + " AS need_follow, "
    + _C("(gm_bpa + org_bpa) / 2")
    + " AS bpa, stability FROM org)",
    "sets": """SELECT * FROM (VALUES ('OT', 1, 0, 0, 1), ('EDGE', 1, 0, 0, 0), ('CB', 0, 1, 1, 0), ('WR', 0, 1, 1, 1), ('QB', 0, 1, 0, 1), ('S', 0, 1, 1, 0)) v(label, tr, skq, sk, off)""",
}


def _priors(t: Tables) -> DataFrame:
    org = t.org()
    return org.select("team", *[c.alias(n) for n, c in S.priors({c: F.col(c) for c in org.columns if c != "team"}).items()])


@query(sql(f"SELECT team, {rounded('offense', 'defense', 'trenches', 'skill', 'need_follow', 'bpa', 'stability')} FROM pr", "org", **_PRIORS))
def org_priors(t: Tables) -> DataFrame:
    return six(_priors(t))


_ADJUSTED = _VEC | _PRIORS | {
    "tv": "SELECT n_name AS team, label, prob FROM gd JOIN nation ON row_id = n_nationkey",
    "rw": "SELECT team, label, greatest(0, prob * (1 + tr * (trenches - 0.5) * 0.6 + skq * (skill - 0.5) * 0.4 + (CASE off WHEN 1 THEN offense ELSE defense END - 0.5) * 0.5)) AS p, prob FROM tv JOIN pr USING (team) JOIN sets USING (label)",
    "oa": "SELECT team, label, p / sum(p) OVER (PARTITION BY team) AS prob, prob AS base FROM rw",
}


def _team_vectors(t: Tables) -> DataFrame:
    return _guarded(t).join(t.nation, F.col("row_id") == F.col("n_nationkey")).select(F.col("n_name").alias("team"), "label", "prob")


@query(sql("SELECT team, label, round(base, 6) AS base, round(prob, 6) AS adjusted, round(prob - base, 6) AS delta FROM oa", "org", **_ADJUSTED))
def org_position_adjust(t: Tables) -> DataFrame:
    base = _team_vectors(t)
    both = probs.zip_vectors(base, probs.org_adjusted(base, _priors(t), ["team"]), ["team"])
    return six(both.select("team", "label", F.col("a").alias("base"), F.col("b").alias("adjusted"), (F.col("b") - F.col("a")).alias("delta")))


def _comp(t: Tables) -> DataFrame:
    names = ["offense", "defense", "trenches", "skill", "need_follow", "bpa", "stability"]
    rows = _team_vectors(t).join(_priors(t), "team")
    return rows.withColumn("component", S.org_component(F.col("label"), {n: F.col(n) for n in names}))


_CO = _ADJUSTED | {
    "co": "SELECT *, " + _C("0.5 + tr * (trenches - 0.5) * 0.9 + sk * (skill - 0.5) * 0.7 + (CASE off WHEN 1 THEN offense ELSE defense END - 0.5) * 0.6 + (need_follow - bpa) * 0.2") + " AS component FROM tv JOIN pr USING (team) JOIN sets USING (label)",
}


@query(sql("SELECT team, label, round(component, 6) AS component, round(p / sum(p) OVER (PARTITION BY team), 6) AS prob FROM (SELECT *, prob * greatest(0, 1 + 0.7 * (component - 0.5)) AS p FROM co)", "org", **_CO))
def org_player_adjust(t: Tables) -> DataFrame:
    factor = F.greatest(F.lit(0.0), 1 + 0.7 * (F.col("component") - 0.5))
    return six(probs.reweigh(_comp(t), factor, ["team"]).select("team", "label", "component", "prob"))


@query(
    sql(
        """SELECT team, team || ' enters this pick as a ' || CASE WHEN stability >= 0.6 THEN 'stable regime' ELSE 'transitional regime' END || ' with a ' || CASE WHEN offense >= defense THEN 'offense' ELSE 'defense' END
           || '-leaning, ' || CASE WHEN need_follow >= bpa THEN 'need-aligned' ELSE 'BPA-leaning' END || ' front-office profile. Need and board context surface ' || label || ', while organizational priors '
           || CASE WHEN component >= 0.62 THEN 'strongly' ELSE 'moderately' END || ' reinforce ' || 'the first ' || label || ' as the preferred selection path.' AS explanation
           FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(prob, 9) DESC, label) AS rn FROM co) WHERE rn = 1""",
        "org", **_CO,
    )
)
def org_explanation(t: Tables) -> DataFrame:
    top = consensus.ranked(_comp(t), ["team"], [F.round("prob", 9).desc(), F.col("label")], 1)
    p = {n: F.col(n) for n in ("offense", "defense", "need_follow", "bpa", "stability")}
    return top.select("team", S.explanation(F.col("team"), F.col("label"), F.concat(F.lit("the first "), F.col("label")), p, F.col("component")).alias("explanation"))


_BLEND = _ADJUSTED | {
    "bl": "SELECT team, label, p / sum(p) OVER (PARTITION BY team) AS prob FROM (SELECT team, label, 0.45 * coalesce(a.prob, 0) + 0.55 * coalesce(b.prob, 0) AS p FROM (SELECT team, CASE label WHEN 'CB' THEN 'NB' ELSE label END AS label, prob FROM tv) a FULL JOIN (SELECT team, CASE label WHEN 'WR' THEN 'SLOT' ELSE label END AS label, prob FROM oa) b USING (team, label))",
}


def _blended(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = _team_vectors(t)
    org = probs.org_adjusted(base, _priors(t), ["team"])
    called = lambda rows, old, new: rows.withColumn("label", F.when(F.col("label") == old, new).otherwise(F.col("label")))
    return base, org, probs.blend(called(base, "CB", "NB"), called(org, "WR", "SLOT"), ["team"])  # each has a label of its own


@query(sql("SELECT team, label, round(prob, 6) AS prob FROM bl", "org", **_BLEND))
def blend_ensemble(t: Tables) -> DataFrame:
    return six(_blended(t)[2])


@query(
    sql(
        """SELECT model, round(avg(-ln(greatest(1e-12, least(1, coalesce(prob, 1e-12))))), 6) AS log_loss, round(avg((coalesce(rank, 9) <= 1)::INT::DOUBLE), 6) AS top1, round(avg((coalesce(rank, 9) <= 3)::INT::DOUBLE), 6) AS top3
           FROM (SELECT * FROM (SELECT DISTINCT model FROM al), tr) LEFT JOIN al USING (model, team, label) GROUP BY model""",
        "org", **_BLEND,
        al="SELECT *, row_number() OVER (PARTITION BY model, team ORDER BY round(prob, 9) DESC, label) AS rank FROM (SELECT 'base' AS model, team, label, prob FROM tv UNION ALL SELECT 'adjusted', team, label, prob FROM oa UNION ALL SELECT 'ensemble', team, label, prob FROM bl)",
        tr="SELECT n_name AS team, ['OT', 'EDGE', 'CB', 'WR', 'QB', 'S'][n_nationkey * 5 % 6 + 1] AS label FROM nation",
    )
)
def prob_eval_logloss_topk(t: Tables) -> DataFrame:
    base, org, ensemble = _blended(t)
    names = F.array(*map(F.lit, ("OT", "EDGE", "CB", "WR", "QB", "S")))
    truth = t.nation.select(F.col("n_name").alias("team"), F.get(names, F.col("n_nationkey") * 5 % 6).alias("label"))
    return six(probs.evaluate({"base": base, "adjusted": org, "ensemble": ensemble}, truth, "team"))


@query(
    sql(
        """SELECT team, label, round(p / sum(p) OVER (PARTITION BY team), 6) AS prob FROM (SELECT team, position AS label, greatest(0.01, 1 - 0.1 * (row_number() OVER (PARTITION BY team ORDER BY round(overall, 9) DESC, position) - 1))::DOUBLE AS p FROM needs)""",
        "needs",
    )
)
def fallback_ranked(t: Tables) -> DataFrame:
    return six(probs.decaying(t.needs(), ["team"], [F.round("overall", 9).desc(), F.col("position")], "position"))


@query(sql("SELECT team, position AS label, round(overall / sum(overall) OVER (PARTITION BY team), 6) AS prob FROM needs", "needs"))
def fallback_from_needs(t: Tables) -> DataFrame:
    return six(probs.normalize(t.needs().select("team", F.col("position").alias("label"), F.col("overall").alias("prob")), ["team"]))


@query(
    sql(
        """SELECT slot, label, round(prob, 6) AS prob FROM (SELECT slot, cand AS label, probability AS prob FROM c WHERE rank <= 5
           UNION ALL SELECT slot, 'other', 1 - sum(probability) FROM c WHERE rank <= 5 GROUP BY slot HAVING sum(probability) > 0.001 AND sum(probability) < 0.98)""",
        "votes", **consensus_ctes("votes", "c"),
    )
)
def chart_residual(t: Tables) -> DataFrame:
    top = consensus.consensus(t.votes(), t.as_of).select("slot", F.col("cand").alias("label"), F.col("probability").alias("prob"))
    return six(probs.chart_slices(top, ["slot"]))


@query(
    sql(
        "SELECT team, coalesce(position, 'UNK') AS position, count(*) AS n FROM (SELECT v.team, CASE WHEN v.slot <> 2 THEN v.cand END AS position FROM votes v WHERE slot <= 2 AND team IS NOT NULL) GROUP BY ALL",
        "votes",
    )
)
def team_history_distribution(t: Tables) -> DataFrame:
    early = t.votes().filter("slot <= 2 AND team IS NOT NULL")
    return early.groupBy("team", F.coalesce(F.when(F.col("slot") != 2, F.col("cand")), F.lit("UNK")).alias("position")).agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        """SELECT slot, team, n, last_article FROM (SELECT slot, team, count(*) AS n, row_number() OVER (PARTITION BY slot ORDER BY count(*) DESC, team) AS rn FROM votes WHERE team IS NOT NULL GROUP BY 1, 2)
           JOIN (SELECT slot, max(article) AS last_article FROM votes WHERE team IS NOT NULL GROUP BY slot) USING (slot) WHERE rn = 1""",
        "votes",
    )
)
def draft_order_mode(t: Tables) -> DataFrame:
    known = t.votes().filter("team IS NOT NULL")
    last = known.groupBy("slot").agg(F.max("article").alias("last_article"))
    return upserts.mode(known, ["slot"], "team").join(last, "slot")


@query("SELECT event_type AS family, event_id AS run_id, ts AS created_at, value AS metric FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_model_run(t: Tables) -> DataFrame:
    return models.latest_run(t.events.select(F.col("event_type").alias("family"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("value").alias("metric")))


@query("SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def years_with_features(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    rows = rows.join(t.customer.filter("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.select(F.year("o_orderdate").alias("year")).distinct()


_SEED = "list_sum(list_transform(string_split(n_name, ''), lambda x: ascii(x)))"


@query(
    f"""SELECT n_name AS team, position, round(greatest(0.2, least(0.98, greatest(0.2, least(0.95, 0.2 + ((seed + 11 * i) % 100) / 100.0::DOUBLE * 0.75))
            + CASE WHEN first IS NULL THEN 0.0 ELSE greatest(0, 16 - least(16, first)) / 40.0::DOUBLE END))::DOUBLE, 6) AS need
        FROM (SELECT n_name, {_SEED} AS seed, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey END AS first FROM nation),
             (SELECT p_type AS position, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part))"""
)
def teams_positions_cross(t: Tables) -> DataFrame:
    """Teams with a key that is 3 modulo 4 have no slot of their own."""
    seed = F.aggregate(F.filter(F.split("n_name", ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c))
    types = t.part.select("p_type").distinct().agg(F.array_sort(F.collect_set("p_type")).alias("all")).select(F.posexplode("all").alias("i", "position"))
    rows = t.nation.join(F.broadcast(types), how="cross")  # a handful of positions
    first = F.when(F.col("n_nationkey") % 4 != 3, F.col("n_nationkey"))
    return six(rows.select(F.col("n_name").alias("team"), "position", records.baseline_need(seed, F.col("i"), first).alias("need")))


@query(
    sql(
        """SELECT team, position, round(CASE WHEN position = wanted THEN 0.95 ELSE 0.35 + 0.07 * (i % 5) END, 4)::DOUBLE AS short_term, round(greatest(0.2, CASE WHEN position = wanted THEN 0.95 ELSE 0.35 + 0.07 * (i % 5) END - 0.1), 4)::DOUBLE AS long_term,
           round(CASE WHEN position = wanted THEN 0.95 ELSE 0.35 + 0.07 * (i % 5) END, 4)::DOUBLE AS overall
           FROM (SELECT team, max_by(position, overall * 1000 - ascii(position)) AS wanted FROM needs GROUP BY team) JOIN (SELECT p_type AS position, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)) ON TRUE""",
        "needs",
    )
)
def needs_from_board(t: Tables) -> DataFrame:
    """Needs by the list of positions, the one that a board gives the team first; here the board gives its top need."""
    wanted = t.needs().groupBy("team").agg(F.max_by("position", F.col("overall") * 1000 - F.ascii("position")).alias("wanted"))
    types = t.part.select("p_type").distinct().agg(F.array_sort(F.collect_set("p_type")).alias("all")).select(F.posexplode("all").alias("i", "position"))
    rows = wanted.join(F.broadcast(types), how="cross")  # a handful of positions
    return rows.select("team", "position", *[c.alias(n) for n, c in records.board_need(F.col("i"), F.col("position") == F.col("wanted")).items()])


@query(
    """SELECT y::INT AS year, make_date(y - 1, 8, 1) AS start_date, make_date(y, 4, 25) AS draft_date, count(o_orderkey) AS orders FROM range(1980, 2031) t(y)
       LEFT JOIN orders ON o_orderdate::DATE >= make_date(y - 1, 8, 1) AND o_orderdate::DATE <= make_date(y, 4, 25) GROUP BY y"""
)
def calendar_dim(t: Tables) -> DataFrame:
    """The calendar of seasons with the orders of each; a day is in the season of its year, or from August on in the next one's."""
    day = F.col("o_orderdate").cast("date")
    n = t.orders.groupBy(F.when(F.month(day) >= 8, F.year(day) + 1).otherwise(F.year(day)).alias("year"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    seasons = F.broadcast(records.calendar(t.spark))  # a row for each of some fifty years
    inside = (n["year"] == seasons["year"]) & (F.col("day") >= F.col("start_date")) & (F.col("day") <= F.col("draft_date"))
    of = n.join(seasons.select("year", "start_date", "draft_date"), inside).groupBy(n["year"].alias("year")).agg(F.sum("n").alias("orders"))
    return seasons.join(of, "year", "left").fillna(0, ["orders"])


@query(f"SELECT n_name AS team, round(0.3 + ({_SEED} % 100) / 100.0::DOUBLE * 0.5, 6) AS score FROM nation")
def synthetic_scores(t: Tables) -> DataFrame:
    return six(t.nation.select(F.col("n_name").alias("team"), records.seeded_score(F.col("n_name"), 0.3, 0.8).alias("score")))


_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


@query(
    rf"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(t, ' ' || chr(10))), '{_PUNCT}', '', 'g'), '\s+', ' ', 'g'), '\b(jr|sr|ii|iii|iv)\b', '', 'g')) AS name,
        trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key, regexp_replace(lower(trim(t, ' ' || chr(10))), '[^a-z0-9]+', '-', 'g') AS slug
        FROM (SELECT item_id, '  ' || text || ' Jr. O''Neil II ' AS t FROM benchmark)"""
)
def normalize_names(t: Tables) -> DataFrame:
    text = F.concat(F.lit("  "), F.col("text"), F.lit(" Jr. O'Neil II "))
    return t.benchmark.select("item_id", X.normalize(text).alias("name"), X.name_key(text).alias("key"), X.slug(text).alias("slug"))


_LABELS = [("de", "Ohio St.", "jets"), ("T", "Ole Miss", "New York Jets"), (" qb ", "Yale", "Los Angeles"), ("nickel", "LSU", "49ers"), ("", "Louisiana State", "la rams"), (None, None, None), ("FS", "ohio  st", " ")]


@query(
    """SELECT c_custkey, position, school, team FROM customer JOIN (VALUES (0::BIGINT, 'EDGE', 'ohio state', 'JETS'), (1, 'OT', 'mississippi', 'NYJ'), (2, 'QB', 'yale', NULL), (3, 'NICKEL', 'lsu', 'SF'),
       (4, '', 'lsu', 'LAR'), (5, NULL, NULL, NULL), (6, 'S', 'ohio state', NULL)) v(id, position, school, team) ON id = c_custkey % 7"""
)
def canonical_labels(t: Tables) -> DataFrame:
    """Customers, each with the labels of one of a few players."""
    label = lambda k: F.get(F.array(*[F.lit(x[k]).cast("string") for x in _LABELS]), (F.col("c_custkey") % len(_LABELS)).cast("int"))
    return t.customer.select("c_custkey", X.position(label(0)).alias("position"), X.school(label(1)).alias("school"), X.team_code(label(2), team_aliases()).alias("team"))


_PAST = ("HOU", "LA", " stl", "SD", "OAK", "BAL1", "KC")


@query(
    """SELECT season, team, count(*) AS n FROM (SELECT year(o_orderdate)::INT + 7 AS season, CASE k WHEN 0 THEN CASE WHEN year(o_orderdate) + 7 < 2002 THEN 'TEN' ELSE 'HOU' END ELSE ['LAR', 'LAR', 'LAC', 'LV', 'IND', 'KC'][k] END AS team
       FROM (SELECT o_orderdate, o_custkey % 7 AS k FROM orders)) GROUP BY 1, 2"""
)
def historical_code_map(t: Tables) -> DataFrame:
    """Orders as moves of teams with codes of their time."""
    code, season = F.get(F.array(*map(F.lit, _PAST)), (F.col("o_custkey") % len(_PAST)).cast("int")), F.year("o_orderdate") + 7
    return t.orders.select(season.alias("season"), X.current_code(code, season).alias("team")).groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(concat_ws('|', source, text, length(text)::VARCHAR)) AS content_hash FROM documents) GROUP BY 1")
def content_hash_dedupe(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", X.content_hash(F.col("source"), F.col("text"), F.length("text").cast("string")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_LATEST = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events {}) WHERE rn = 1"


@query(f"WITH o AS ({_LATEST.format('WHERE event_id % 3 = 0')}), n AS ({_LATEST.format('WHERE event_id % 3 <> 0')}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM n)")
def upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    old = upserts.keep_latest(rows.filter("event_id % 3 = 0"), ["user_id", "event_type"], [F.col("event_id").desc()])
    new = rows.filter("coalesce(event_id % 3, 1) <> 0")  # every event that is not old
    return upserts.upsert(old, new, ["user_id", "event_type"], "event_id")


@query("SELECT item_id AS user_id, n AS name FROM (SELECT row_number() OVER (ORDER BY n) + 5 AS item_id, n FROM (SELECT DISTINCT event_type AS n FROM events WHERE event_type <> 'click')) UNION ALL SELECT 5, 'click'")
def get_or_create_dim(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([(5, "click")], "user_id long, name string")
    return upserts.get_or_create(dim, t.events.select(F.col("event_type").alias("name")), "name", "user_id")


@query(
    """SELECT min(y)::INT AS min_year, max(y)::INT AS max_year, count(*) FILTER (NOT bad) AS inserted, count(*) FILTER (bad) AS failed, 'partial' AS status
       FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN year(ts) END AS y, user_id % 7 = 0 OR event_type = 'error' AS bad FROM events WHERE TRUE) WHERE y IS NOT NULL OR bad"""
)
def csv_rejects(t: Tables) -> DataFrame:
    """Text records with unreadable years and blank names, cast and counted."""
    raw = t.events.select(
        F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(F.year("ts").cast("string")).alias("draft_year"), F.lit(" 1 ").alias("round_number"), F.col("event_id").cast("string").alias("overall_pick"),
        F.lit("KC").alias("team_abbrev"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("player_name"),
    )
    good, bad = records.split_rejects(records.typed(raw, records.OUTCOMES), ["draft_year", "overall_pick", "player_name"])
    return records.audit(good, bad, "draft_year")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def nested_articles(t: Tables) -> DataFrame:
    nested = records.nest_articles(t.conversations, ["conv_id"], ["turn", "role"])
    return nested.select("conv_id", F.size("picks").cast("long").alias("n_turns"), F.array_join(F.transform("picks", lambda p: p["role"]), ",").alias("roles"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, CASE WHEN event_id % 3 = 0 THEN [event_type] ELSE [] END AS items FROM events")
def json_props(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type"))).when(F.col("event_id") % 3 == 1, "{broken")
    return t.events.select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k"), X.json_list(text).alias("items"))


@query(
    sql(
        """SELECT slot, n, CASE WHEN r >= 0.75 THEN 'high' WHEN r >= 0.5 THEN 'good' WHEN r >= 0.25 THEN 'fair' ELSE 'low' END AS bucket
           FROM (SELECT slot, n, n / max(n) OVER ()::DOUBLE AS r FROM (SELECT slot, count(*) AS n FROM votes GROUP BY slot))""",
        "votes",
    )
)
def coverage_buckets(t: Tables) -> DataFrame:
    rows = t.votes().groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    top = rows.agg(F.max("n").alias("top"))
    r = F.col("n") / F.col("top")
    bucket = F.when(r >= 0.75, "high").when(r >= 0.5, "good").when(r >= 0.25, "fair").otherwise("low")
    return rows.join(F.broadcast(top), how="cross").select("slot", "n", bucket.alias("bucket"))


@query(
    sql(
        """, g AS (SELECT 1 AS slot, (SELECT cand FROM c WHERE slot = 1 AND rank = 1) AS cand, [(SELECT cand FROM c WHERE slot = 1 AND rank = 1)] AS used
             UNION ALL SELECT g.slot + 1, x.cand, list_append(used, x.cand) FROM g, LATERAL (SELECT coalesce(min_by(cand, rank) FILTER (NOT list_contains(used, cand)), min_by(cand, rank)) AS cand FROM c WHERE c.slot = g.slot + 1 AND rank <= 5) x WHERE g.slot < 7)
           SELECT slot, cand FROM g""",
        "votes", **consensus_ctes("votes", "c"),
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n, g", "), g")
)
def greedy_ladder(t: Tables) -> DataFrame:
    return consensus.ladder(consensus.consensus(t.votes(), t.as_of))


@query(
    sql(
        """SELECT team, n.rank::INT AS rank, position, coalesce(p.candidate_id, o.candidate_id) AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(need, 9) DESC, position) AS rank FROM nd) n
           LEFT JOIN (SELECT team, position, min_by(candidate_id, (-round(probability, 9), candidate_id)) AS candidate_id FROM hp GROUP BY ALL) p USING (team, position)
           LEFT JOIN (SELECT team, min_by(candidate_id, (-round(probability, 9), candidate_id)) AS candidate_id FROM hp GROUP BY ALL) o USING (team) WHERE n.rank <= 2""",
        "needs", "candidates", **_SCORED,
    )
)
def scenario_pairs(t: Tables) -> DataFrame:
    top = consensus.ranked(_need(t), ["team"], [F.round("need", 9).desc(), F.col("position")], 2)
    rows = candidates.score(_rows(t))
    # A team's first is the first of its positions' firsts, so the candidates are gone through once for both.
    key = F.struct(-F.round("probability", 9), F.col("candidate_id"))
    firsts = rows.groupBy("team", "position").agg(F.min(key).alias("first")).select("team", F.col("position").alias("of"), "first")
    own = F.min(F.when(F.col("of") == F.col("position"), F.col("first")))["candidate_id"]
    out = top.join(firsts, "team", "left").groupBy("team", "rank", "position").agg(own.alias("own"), F.min("first")["candidate_id"].alias("any"))
    return out.select("team", "rank", "position", F.coalesce("own", "any").alias("candidate_id"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8 OFFSET 16")
def result_page(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(16).limit(8)


from augury.plans import intake, kept, profiles, scouting  # noqa: E402, F401  they register their queries
