"""Queries about what is read from files and pages of scouts: manual mocks, rosters, orders, boards, staff, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions.teams import TEAMS, teams
from augury.operators import models, org, probs
from augury.plans.queries import _VEC, _vectors
from augury.plans.register import query, six
from augury.plans.tables import Tables, sql
from augury.sources import html, records


def _one_of(values: tuple[str | None, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values)).cast("int"))


@query(
    """SELECT overall_pick, round_number, original_team, traded, count(*) AS n, count(school) AS schools FROM (
         SELECT nullif(l_linenumber, 7) AS overall_pick, CASE WHEN l_partkey % 5 = 4 THEN NULL ELSE (l_partkey % 5 + 1)::INT END AS round_number, ['Jets', NULL, 'New York'][l_suppkey % 3 + 1] AS original_team,
           l_orderkey % 4 = 1 AS traded, CASE WHEN l_orderkey % 2 = 0 THEN 'Yale' END AS school FROM lineitem) GROUP BY ALL"""
)
def manual_mocks(t: Tables) -> DataFrame:
    """Lines as rows of manual mocks, all text: numbers that are none, blank teams, and all that is not "true" in some spelling."""
    raw = t.lineitem.select(
        F.when(F.col("l_partkey") % 5 == 4, "first").otherwise((F.col("l_partkey") % 5 + 1).cast("string")).alias("round_number"), F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.lit(" "), F.col("l_linenumber"))).alias("overall_pick"),
        _one_of(("Jets", " ", "New York "), F.col("l_suppkey")).alias("original_team"), F.lit("").alias("current_team"), _one_of(("no", "TRUE", None, "1"), F.col("l_orderkey")).alias("traded"),
        F.lit("Al Poe").alias("player_name"), F.lit("QB").alias("position"), F.when(F.col("l_orderkey") % 2 == 0, "Yale").otherwise("").alias("school"),
    )
    rows = records.manual_picks(raw)
    return rows.groupBy("overall_pick", "round_number", F.trim("original_team").alias("original_team"), "traded").agg(F.count(F.lit(1)).alias("n"), F.count("school").alias("schools"))


@query(
    """SELECT starter_flag, injury_flag, count(*) AS n, sum(snaps)::BIGINT AS snaps FROM (SELECT [true, true, false, NULL, true, false][l_orderkey % 6 + 1] AS starter_flag, [NULL, true, false][l_partkey % 3 + 1] AS injury_flag,
       CASE WHEN l_linenumber <> 5 THEN trunc(l_quantity)::INT END AS snaps FROM lineitem) GROUP BY ALL"""
)
def roster_files(t: Tables) -> DataFrame:
    """Lines as rows of a roster file: flags of three states, in several spellings."""
    raw = t.lineitem.select(
        _one_of(("1", " Yes", "no", " ", "T", "0"), F.col("l_orderkey")).alias("starter_flag"), _one_of((None, "y", "f"), F.col("l_partkey")).alias("injury_flag"),
        F.when(F.col("l_linenumber") == 5, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("snaps"),
    )
    rows = records.typed(raw, "snaps int, starter_flag boolean, injury_flag boolean")
    return rows.groupBy("starter_flag", "injury_flag").agg(F.count(F.lit(1)).alias("n"), F.sum("snaps").alias("snaps"))


_CODES = tuple(c for c, _, _ in TEAMS)[:8]


@query(
    f"""SELECT (p_partkey + 1)::INT AS slot, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE (p_partkey % 3 + 1)::INT END AS round, (p_partkey % 9 + 1)::BIGINT AS team_id FROM part WHERE p_partkey % 9 < 8 AND p_partkey % 10 <> 0"""
)
def order_files(t: Tables) -> DataFrame:
    """Parts as rows of an order's file: rows without a number or a known team are left out, one without a round is of the first."""
    k = F.col("p_partkey")
    raw = t.part.select(F.when(k % 10 == 0, "x").otherwise((k + 1).cast("string")).alias("overall_pick"), F.when(k % 3 != 0, (k % 3 + 1).cast("string")).alias("round_number"), F.lower(_one_of((*_CODES, "nobody"), k)).alias("team_abbreviation"))
    return records.draft_order(raw, teams(t.spark))


_PLACES, _SCHOOLS = ("QB", "DE", "T", "WR", "FS", "NICK"), ("Ohio St.", "Yale", "Texas A&M")
_SCOUTED = """SELECT key, name, position, school, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n FROM (
    SELECT min(p_partkey) AS key, p_name || ' ' || p_partkey % 150 AS name, min_by(['QB', 'EDGE', 'OT', 'WR', 'S', 'NICK'][p_partkey % 6 + 1], p_partkey) AS position, min_by(['Ohio St.', 'Yale', 'Texas A&M'][p_partkey % 3 + 1], p_partkey) AS school
    FROM part WHERE p_partkey % 7 <> 0 GROUP BY 2 ORDER BY key LIMIT {})"""


def _anchors(t: Tables) -> DataFrame:
    """Parts as links of a board: name, position and school; every seventh has no school."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("  "), "p_name", F.lit(" "), (k % 150).cast("string"), F.lit(" "), _one_of(_PLACES, k), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" | "), _one_of(_SCHOOLS, k))))
    return t.part.select(k.alias("key"), text.alias("text"))


@query(
    f"""SELECT key, name, name AS normalized, position, school, place::INT AS place, round(greatest(0.1, 1 - (place - 1) / (n + 8.0::DOUBLE)), 6) AS prospect, round(greatest(0.1, 0.95 * greatest(0.1, 1 - (place - 1) / (n + 8.0::DOUBLE))), 6) AS star
        FROM ({_SCOUTED.format(128)})"""
)
def scouted_prospects(t: Tables) -> DataFrame:
    return six(html.prospects(_anchors(t), "key", "text"))


@query(sql(f"SELECT place::INT AS slot, name, position, school, team FROM ({_SCOUTED.format(32)}) JOIN draft_order ON slot = place", "draft_order"))
def scouted_mock_board(t: Tables) -> DataFrame:
    """The first 32 names in their order, each at a slot and for its team."""
    return html.mock_board(_anchors(t), "key", "text", t.order().withColumn("round", F.lit(1)))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Al Poe ' || chr(65 + n_nationkey::INT) WHEN 1 THEN 'Ann Lee-' || chr(65 + n_nationkey::INT) END AS coach,
       CASE WHEN n_nationkey % 4 = 0 THEN 'Bo Ray' END AS manager FROM nation"""
)
def staff_names(t: Tables) -> DataFrame:
    """Each nation's two pages: a coach in the first one's box, or in the second one's description, or nowhere; a manager in a box."""
    k, letter = F.col("n_nationkey"), F.char(F.col("n_nationkey") + 65)
    coach = F.when(k % 3 == 0, F.concat(F.lit("<tr><th> Head coach: </th> <td><a href='/c'> Al Poe "), letter, F.lit(" </a></td></tr>"))).otherwise("<p>Head coach</p>")
    manager = F.when(k % 4 == 0, "<li><strong class='x'>General manager</strong> Bo Ray <br></li>").otherwise("")
    second = F.when(k % 3 == 1, F.concat(F.lit('<meta name="description" content="A team. Head coach: Ann Lee-'), letter, F.lit('">')))
    pages = t.nation.select(k, F.when(k % 3 != 1, F.concat(coach, manager)).otherwise(manager).alias("first"), second.alias("second"))
    return html.staff_of(pages, "n_nationkey", "first", "second", {"coach": "Head coach", "manager": "General manager"})


@query(
    sql(
        """SELECT team, year, slot, round, position, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY year DESC, slot DESC, position) AS place FROM (
             SELECT team, year(published)::INT AS year, slot, CASE WHEN slot <= 4 THEN 1 ELSE 2 END AS round, cand AS position FROM votes WHERE team IS NOT NULL) WHERE year >= 1997 AND year < 2000) WHERE place <= 30""",
        "votes",
    )
)
def team_history(t: Tables) -> DataFrame:
    """Each team's last thirty picks of three years."""
    votes = t.votes().filter("team IS NOT NULL").select("team", F.year("published").alias("year"), "slot", F.when(F.col("slot") <= 4, 1).otherwise(2).alias("round"), F.col("cand").alias("position"))
    return org.history(votes, t.nation.select(F.col("n_name").alias("team")), 2000, 3).filter("place <= 30")


@query(sql("SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY round(prob, 9) DESC, label)::INT - 1 AS place, label, round(prob, 6) AS prob FROM vec", **_VEC))
def ranked_vectors(t: Tables) -> DataFrame:
    """Whole vectors as arrays by falling probability, taken apart again."""
    listed = probs.as_map(_vectors(t), ["row_id"])
    return six(listed.select("row_id", F.posexplode("ranked").alias("place", "x")).select("row_id", "place", "x.label", "x.prob"))


@query(
    sql(
        """SELECT cycle, top_need_position, count(*) AS n, round(sum(coalesce(overall, 0.5)), 6) AS need FROM (SELECT year(o_orderdate)::INT AS cycle, n_name AS team, ['ECONOMY', 'KICKER', 'LARGE', 'NONE'][o_orderkey % 4 + 1] AS top_need_position
             FROM orders JOIN nation ON o_custkey % 25 = n_nationkey) o LEFT JOIN needs ON needs.team = o.team AND needs.position = o.top_need_position AND o.cycle < 1997 GROUP BY ALL""",
        "needs",
    )
)
def position_training_rows(t: Tables) -> DataFrame:
    """Orders as contexts of picks, with the need of their position; needs are known for some years."""
    context = t.orders.join(F.broadcast(t.nation), F.col("o_custkey") % 25 == F.col("n_nationkey"))
    context = context.select(F.year("o_orderdate").alias("cycle"), F.col("n_name").alias("team"), _one_of(("ECONOMY", "KICKER", "LARGE", "NONE"), F.col("o_orderkey")).alias("top_need_position"))
    years = F.explode(F.sequence(F.lit(1990), F.lit(1996))).alias("cycle")
    rows = models.position_rows(context, t.needs().select(years, "team", "position", F.col("overall").alias("need")))
    return six(rows.groupBy("cycle", "top_need_position").agg(F.count(F.lit(1)).alias("n"), F.sum("need_score").alias("need")))
