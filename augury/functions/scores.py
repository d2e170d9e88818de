"""Scoring formulas, Column in, Column out. Doubles throughout; null inputs are coalesced before clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.5
TRENCHES = ("OT", "IOL", "C", "G", "EDGE", "DT")
SKILL = ("WR", "RB", "TE", "CB", "S")
OFFENSE = ("QB", "RB", "WR", "TE", "OT", "IOL", "C", "G")
# Snaps of a full room by position, and for any other position.
CAPACITY = {
    "QB": 1100, "RB": 950, "WR": 2000, "TE": 850, "OT": 2200, "IOL": 2200, "EDGE": 1900, "DT": 1700,
    "LB": 1900, "CB": 1900, "S": 1600, "FB": 400, "K": 200, "P": 200, "LS": 200,
}
OTHER_CAPACITY = 1600


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def age_days(published: Column, as_of: Column) -> Column:
    """Whole elapsed days, not below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400)).cast("double")


def decay(age: Column, tau_days: Column) -> Column:
    """exp(-age / tau): e-folding, not halving."""
    return F.exp(-age / F.greatest(F.lit(1.0), tau_days))


def slot_pool(slot: Column) -> Column:
    return F.least(F.lit(28), F.greatest(F.lit(6), F.lit(3) + F.floor(slot / 2).cast("int")))


def evidence_pool(teams: Column, rows: Column, sources: Column, articles: Column, earliest: Column) -> Column:
    """Categories of the landing prior: fewer as the evidence grows."""
    low = teams + 1
    per = lambda x: F.floor(F.lit(x) / (rows + 2)).cast("long")
    slot = F.greatest(F.lit(1), F.least(F.lit(256), earliest))
    several = F.greatest(low, F.least(F.lit(24), low + F.greatest(F.lit(0), 8 - F.floor(rows / 4).cast("long"))))
    k = 2 + F.greatest(F.lit(0), F.least(F.lit(6), per(28)))
    early = ((slot <= 6) & (rows >= 6)) | ((slot <= 12) & (rows >= 10))
    for less in (sources <= 1, articles >= 8, early):
        k = F.when(less, F.greatest(low, k - 1)).otherwise(k)
    k = F.when(sources >= 3, low).when((sources == 2) & (rows >= 10), F.greatest(low, F.least(k, low + 1))).otherwise(k)
    single = (
        F.when(rows <= 4, F.greatest(low, F.least(F.lit(32), 4 + per(30))))
        .when(rows <= 6, F.greatest(low, F.least(F.lit(10), 3 + per(20))))
        .otherwise(F.least(F.lit(32), F.greatest(low, k)))
    )
    return F.when(teams >= 2, several).otherwise(single).cast("long")


def smoothed(value: Column, total: Column, k: Column, alpha: float = ALPHA) -> Column:
    return (value + alpha) / (total + alpha * k)


def smoothed_other(total: Column, listed: Column, k: Column, alpha: float = ALPHA) -> Column:
    return (alpha * (k - listed)) / (total + alpha * k)


def need_scores(snaps: Column, starts: Column, age: Column, experience: Column, depth: Column, continuity: Column, injury: Column) -> dict[str, Column]:
    scarce = lambda x, full: clip(1 - x / full)
    parts = {
        "snaps_risk": scarce(snaps, 3500.0),
        "starts_risk": scarce(starts, 85.0),
        "depth_risk": scarce(depth, 6.0),
        "age_risk": clip((age - 25.0) / 8.0),
        "experience_risk": scarce(experience, 6.0),
        "continuity_risk": clip(1 - continuity),
    }
    p = parts
    short = clip(0.32 * p["snaps_risk"] + 0.24 * p["starts_risk"] + 0.18 * p["continuity_risk"] + 0.12 * clip(injury) + 0.14 * p["depth_risk"])
    long = clip(0.4 * p["age_risk"] + 0.35 * p["experience_risk"] + 0.25 * p["depth_risk"])
    return parts | {"short_term": short, "long_term": long, "overall": clip(0.55 * short + 0.45 * long)}


def capacity(position: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in CAPACITY.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.upper(position)), F.lit(float(OTHER_CAPACITY)))


def dampened_need(base: Column, strength: Column, dampen: float = 0.72) -> Column:
    less = clip(base * F.greatest(F.lit(0.08), 1 - dampen * strength), 0.04, 0.99)
    return F.when(strength <= 0, clip(base)).otherwise(less)


def heuristic_candidate(need: Column, prospect: Column, star: Column, rank: Column, scarcity: Column) -> Column:
    return clip(0.3 * need + 0.3 * prospect + 0.2 * star + 0.15 * F.greatest(F.lit(0.0), 1 - rank / 300.0) + 0.05 * scarcity)


def override(need: Column, talent: Column, probability: Column) -> Column:
    return clip(F.greatest(F.lit(0.0), 1 - need) * clip((talent - 0.65) / 0.35) * clip((probability - 0.2) / 0.8) * 2.2)


def priors(f: dict[str, Column]) -> dict[str, Column]:
    """Organisational priors of gm_, coach_ and org_ features; a null feature is neutral."""
    v = {k: F.coalesce(c, F.lit(0.5)) for k, c in f.items()}
    offense = clip((v["gm_offense"] + v["coach_offense"] + v["org_offense"]) / 3)
    trenches = clip((v["gm_trenches"] + v["coach_trenches"] + v["org_trenches"]) / 3)
    return {
        "offense": offense,
        "defense": clip(1 - offense),
        "trenches": trenches,
        "skill": clip(1 - trenches),
        "need_follow": clip((v["gm_need"] + v["org_need"]) / 2),
        "bpa": clip((v["gm_bpa"] + v["org_bpa"]) / 2),
        "stability": clip(v["stability"]),
    }


def _lean(position: Column, members: tuple[str, ...], prior: Column, factor: float) -> Column:
    return F.when(position.isin(*members), (prior - 0.5) * factor).otherwise(0.0)


def position_modifier(position: Column, p: dict[str, Column]) -> Column:
    side = F.when(position.isin(*OFFENSE), p["offense"]).otherwise(p["defense"])
    return 1.0 + _lean(position, TRENCHES, p["trenches"], 0.6) + _lean(position, (*SKILL, "QB"), p["skill"], 0.4) + (side - 0.5) * 0.5


def org_component(position: Column, p: dict[str, Column]) -> Column:
    side = F.when(position.isin(*OFFENSE), p["offense"]).otherwise(p["defense"])
    lean = _lean(position, TRENCHES, p["trenches"], 0.9) + _lean(position, SKILL, p["skill"], 0.7)
    return clip(0.5 + lean + (side - 0.5) * 0.6 + (p["need_follow"] - p["bpa"]) * 0.2)


def explanation(team: Column, position: Column, player: Column, p: dict[str, Column], component: Column) -> Column:
    return F.format_string(
        "%s enters this pick as a %s with a %s-leaning, %s front-office profile. Need and board context surface %s, "
        "while organizational priors %s reinforce %s as the preferred selection path.",
        team,
        F.when(p["stability"] >= 0.6, "stable regime").otherwise("transitional regime"),
        F.when(p["offense"] >= p["defense"], "offense").otherwise("defense"),
        F.when(p["need_follow"] >= p["bpa"], "need-aligned").otherwise("BPA-leaning"),
        position,
        F.when(component >= 0.62, "strongly").otherwise("moderately"),
        player,
    )


def board_score(index: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.1), 1 - index / (n + 8.0))


def accuracy(exact: Column, team: Column, early: Column, distance: Column, rows: Column) -> Column:
    return F.greatest(F.lit(0.0), (4.0 * exact + 2.0 * team + early - 0.25 * distance) / F.greatest(F.lit(1.0), rows / 32.0))


def rank_signal(rank: Column) -> Column:
    """1 for the first of 300 down to 0; 0 without a rank."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - rank / 300.0), F.lit(0.0))


def grouped_explanation(need: Column, scarcity: Column, best: Column) -> dict[str, Column]:
    """Components of a prediction's summary; what the summary lacks is 0."""
    need, scarcity, best = (F.coalesce(c, F.lit(0.0)) for c in (need, scarcity, best))
    return {"need_component": need, "talent_component": best, "context_component": (scarcity + best) / 2.0}


# The groups of features of each family of models.
FEATURE_GROUPS = {
    "need_model": ("team_need", "roster_continuity", "age_curve", "experience_curve"),
    "position_model": ("team_need", "pick_context", "board_context", "consensus_signals"),
    "player_model": ("team_need", "prospect_quality", "superstar_signal", "rank_gap", "board_scarcity"),
}


def feature_groups(family: Column) -> Column:
    table = F.create_map(*[x for k, v in FEATURE_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, family), F.array(F.lit("unknown")))


def or_neutral(value: Column) -> Column:
    """0.5 for null and for 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(0.5)).cast("double")
