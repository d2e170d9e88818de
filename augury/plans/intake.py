"""Queries about what comes in: labels, articles, pages, record files, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.functions.teams import TEAMS, team_aliases, teams
from augury.operators import ingest, upserts
from augury.plans.register import query
from augury.plans.tables import Tables
from augury.sources import articles, html, records
from augury.sources.registry import SourceConfig

_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_text = lambda x: "'" + x.replace("'", "''") + "'"


def _normal(value: str) -> str:
    """normalize() in SQL."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({value})), '{_PUNCT}', '', 'g'), '\s+', ' ', 'g'), '\b(jr|sr|ii|iii|iv)\b', '', 'g'))"


_TEAMS = "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{c}', '{city} {nick}', '{city}', '{nick}')" for k, (c, city, nick) in enumerate(TEAMS, 1)) + ") v(team_id, code, name, city, nick)"
_ALIASES = "SELECT * FROM (VALUES " + ", ".join(f"({_text(a)}, '{c}', {k})" for k, (a, c) in enumerate(team_aliases().items())) + ") v(alias, code, place)"
#: How a customer spells a team, by its key.
_SPELLINGS = {
    0: "lower(code)", 1: "nick", 2: "name", 3: "concat('from the ', name, ' (via trade)')", 4: "city", 5: "concat(' ', upper(nick), '. ')", 6: "'no team here'", 7: "' '",
    8: "concat(city, ' or the ', lower(nick))", 9: "concat('x', lower(name), 'x')", 10: "concat(substr(code, 1, 1), '.', substr(code, 2))",
}
_LABEL = "CASE {key} % 12 " + " ".join(f"WHEN {k} THEN {e}" for k, e in _SPELLINGS.items()) + " END"


def _labels(t: Tables, keys: DataFrame, key: str) -> DataFrame:
    """keys with a column label, the spelling of a team by the key."""
    dim = teams(t.spark).select("team_id", "code", "name", "city", F.expr("substr(name, length(city) + 2)").alias("nick"))
    return keys.join(F.broadcast(dim), F.expr(f"{key} % 32 + 1 = team_id")).withColumn("label", F.expr(_LABEL.format(key=key)))


def _resolved(label: str) -> str:
    """The cascade in SQL over a CTE `labels` with a column of that name: label, team_id."""
    return f"""
    tm AS ({_TEAMS}), al AS ({_ALIASES}),
    u AS (SELECT DISTINCT {label} AS label FROM labels WHERE trim(coalesce({label}, '')) <> ''),
    k AS (SELECT label, {_normal('label')} AS key,
            CASE WHEN length(trim(label)) <= 4 THEN nullif(upper(regexp_replace(trim(label), '[^A-Za-z]', '', 'g')), '') ELSE (SELECT code FROM al WHERE alias = {_normal('label')}) END AS code FROM u),
    hit AS (SELECT label, arg_min(a.code, (-length(a.alias), a.place)) AS code FROM k JOIN al a ON contains(' ' || k.key || ' ', ' ' || a.alias || ' ') GROUP BY label),
    one AS (SELECT lower(city) AS city, min(team_id) AS team_id FROM tm GROUP BY 1 HAVING count(*) = 1),
    rs AS (SELECT k.label, coalesce(a.team_id, b.team_id, c.team_id, d.team_id) AS team_id FROM k LEFT JOIN tm a ON a.code = substr(k.code, 1, 8) LEFT JOIN hit USING (label)
           LEFT JOIN tm b ON b.code = hit.code LEFT JOIN tm c ON lower(c.name) = k.key LEFT JOIN one d ON d.city = k.key)"""


@query(
    f"WITH labels AS (SELECT c_custkey, {_LABEL.format(key='c_custkey')} AS label FROM customer JOIN ({_TEAMS}) ON c_custkey % 32 + 1 = team_id), {_resolved('label')} SELECT c_custkey, label, rs.team_id FROM labels LEFT JOIN rs USING (label)"
)
def resolve_teams(t: Tables) -> DataFrame:
    keys = _labels(t, t.customer.select("c_custkey"), "c_custkey").select("c_custkey", "label")
    return ingest.resolve_teams(keys, "label", teams(t.spark))


@query(
    f"WITH k AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' for the ' || name) AS key FROM part JOIN ({_TEAMS}) ON p_partkey % 32 + 1 = team_id), al AS ({_ALIASES}) SELECT key, arg_min(a.code, (-length(a.alias), a.place)) AS code FROM k JOIN al a ON contains(' ' || key || ' ', ' ' || a.alias || ' ') GROUP BY key"
)
def team_alias_contains_join(t: Tables) -> DataFrame:
    """The longest alias that stands in a label as whole words; runs of words meet the fixed list by equality."""
    named = t.part.join(F.broadcast(teams(t.spark)), F.expr("p_partkey % 32 + 1 = team_id"))
    labels = named.select(F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("for the"), "name")).alias("key")).distinct()
    return ingest.longest_alias(labels, "key")


_SLUGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


def _parsed(t: Tables) -> DataFrame:
    """Orders as articles, their lines as picks; the label is the spelling of the line's supplier."""
    lines = _labels(t, t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"), "l_suppkey")
    pick = F.struct(
        F.col("l_linenumber").alias("overall_pick"), F.col("l_partkey").alias("o"), F.col("l_quantity").alias("q"), F.col("label").alias("current_team"),
    )
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pick)).alias("picks"))
    full = F.transform(
        "picks",
        lambda p: F.struct(
            p["overall_pick"].alias("overall_pick"), F.lit(1).alias("round_number"), F.lit(None).cast("string").alias("original_team"), p["current_team"].alias("current_team"),
            F.lit(False).alias("traded"), F.concat(F.lit("Player "), p["o"]).alias("player_name"), F.lit("de").alias("position"), F.lit(None).cast("string").alias("school"),
        ),
    )
    rows = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("c_mktsegment").alias("source_slug"), F.concat(F.lit("mock://"), "o_orderkey").alias("article_url"), F.col("o_orderpriority").alias("title"),
        F.year("o_orderdate").alias("draft_year"), F.col("o_orderdate").alias("published"), full.alias("picks"), "o_orderkey",
    )


_INGEST = f"""
WITH art AS (SELECT o_orderkey, c_mktsegment AS source_slug, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
ok AS (SELECT * FROM art WHERE source_slug IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AND y < 1998),
lab AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey, {_LABEL.format(key='l_suppkey')} AS label FROM lineitem JOIN ({_TEAMS}) ON l_suppkey % 32 + 1 = team_id),
labels AS (SELECT DISTINCT label FROM lab), {_resolved('label')},
pk AS (SELECT l_orderkey, l_linenumber, team_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, label) AS n,
              first_value(team_id) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, label) AS first_team FROM lab LEFT JOIN rs USING (label))
SELECT source_slug AS source, count(DISTINCT o_orderkey) AS articles, count(*) AS picks, count(CASE WHEN o_orderkey % 3 = 0 THEN first_team ELSE team_id END) AS resolved,
       sum(l_linenumber * CASE WHEN o_orderkey % 3 = 0 THEN first_team ELSE team_id END)::BIGINT AS checksum, NULL::VARCHAR AS reason FROM ok JOIN pk ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT source_slug, count(*), NULL, NULL, NULL, CASE WHEN source_slug = 'MACHINERY' THEN 'unknown source' ELSE 'unknown year' END AS reason FROM art WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ok) GROUP BY 1, 6"""


@query(_INGEST)
def ingest_articles(t: Tables) -> DataFrame:
    """A third of the articles are stored already, without teams: they are not stored again, and get their teams."""
    parsed = _parsed(t)
    spark = t.spark
    sources = spark.createDataFrame([(s,) for s in _SLUGS], "slug string")
    cycles = spark.range(1990, 1998).select(F.col("id").cast("int").alias("year"))
    known = parsed.filter("o_orderkey % 3 = 0 AND draft_year < 1998").filter(F.col("source_slug").isin(*_SLUGS))
    stored = ingest.with_key(known)
    old_articles = stored.select(*ingest.KEY, "title", "draft_year", "published")
    old_picks = ingest.picks_of(stored, teams(spark).limit(0))
    articles, picks, rejected = ingest.ingest(parsed, old_articles, old_picks, sources, cycles, teams(spark))
    n = articles.groupBy(F.col("source_slug").alias("source")).agg(F.count(F.lit(1)).alias("articles"))
    of = picks.groupBy(F.col("source_slug").alias("source")).agg(
        F.count(F.lit(1)).alias("picks"), F.count("current_team_id").alias("resolved"), F.sum(F.col("overall_pick") * F.col("current_team_id")).alias("checksum")
    )
    left = rejected.groupBy(F.col("source_slug").alias("source"), "reason").agg(F.count(F.lit(1)).alias("articles"))
    taken = n.join(of, "source", "left").withColumn("reason", F.lit(None).cast("string"))
    return taken.unionByName(left.select("source", "articles", *[F.lit(None).cast("long").alias(c) for c in ("picks", "resolved", "checksum")], "reason"))


@query(
    """SELECT source_slug, discovered, CASE WHEN skipped THEN 0 ELSE ok END AS fetched, CASE WHEN skipped THEN 0 ELSE ok END AS parsed, CASE WHEN skipped THEN 0 ELSE bad END AS errors,
       CASE WHEN skipped THEN 'skipped' WHEN bad = 0 THEN 'success' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status
       FROM (SELECT source_slug, source_slug = 'HOUSEHOLD' AS skipped, CASE WHEN source_slug = 'HOUSEHOLD' THEN 0 ELSE count(*) END AS discovered,
                    count(*) FILTER (place < 10 AND o_orderstatus <> 'F') AS ok, count(*) FILTER (place < 10 AND o_orderstatus = 'F') AS bad
             FROM (SELECT c_mktsegment AS source_slug, o_orderstatus, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) - 1 AS place FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)"""
)
def job_audit(t: Tables) -> DataFrame:
    """Orders as a source's pages in order of their key; orders of one status can't be read."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("o_orderkey")) - 1
    pages = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source_slug"), place.alias("place"), F.when(F.col("o_orderstatus") == "F", "no picks").alias("fault"))
    sources = t.customer.select(F.col("c_mktsegment").alias("slug")).distinct().withColumn("parser", F.when(F.col("slug") == "HOUSEHOLD", "rss").otherwise("html_static"))
    return ingest.job_audit(pages, sources)


@query(
    """SELECT fault, count(*) AS articles FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown source' WHEN year(o_orderdate) >= 1998 THEN 'unknown year'
       WHEN (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) = 1 THEN 'invalid pick' END AS fault
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY 1"""
)
def dry_run(t: Tables) -> DataFrame:
    """What would keep articles out; a pick's number is its line's less one, so that some are 0."""
    parsed = _parsed(t).withColumn("picks", F.transform("picks", lambda p: F.struct((p["overall_pick"] - 1).alias("overall_pick"))))
    slugs = t.spark.createDataFrame([(s,) for s in _SLUGS], "source_slug string")
    years = t.spark.range(1990, 1998).select(F.col("id").cast("int").alias("draft_year"))
    return records.checked_articles(parsed.select("source_slug", "draft_year", "picks"), slugs, years).groupBy("fault").agg(F.count(F.lit(1)).alias("articles"))


_CODES = "['HOU', 'la', 'STL', 'SD', 'OAK', 'PHO', 'BAL1', 'KC', ' ne ', '', 'LARD', 'LARM']"


@query(
    f"""SELECT draft_year, team_abbrev, count(*) AS n, min(overall_pick)::INT AS first_pick, max(round_number)::INT AS last_round FROM (
        SELECT year(o_orderdate)::INT AS draft_year, o_orderkey % 7 + 1 AS round_number, o_orderkey % 257 + 1 AS overall_pick,
          CASE WHEN code = 'HOU' AND year(o_orderdate) < 2002 THEN 'TEN' ELSE coalesce(MAP {{'LA': 'LAR', 'STL': 'LAR', 'SD': 'LAC', 'OAK': 'LV', 'LARD': 'LV', 'LARM': 'LAR', 'PHO': 'ARI', 'BAL1': 'IND'}}[code], code) END AS team_abbrev
        FROM (SELECT *, upper(trim({_CODES}[o_custkey % 12 + 1])) AS code FROM orders) WHERE code <> '' AND o_orderkey % 11 <> 0 AND year(o_orderdate) BETWEEN 1993 AND 1997) GROUP BY 1, 2"""
)
def csv_contracts(t: Tables) -> DataFrame:
    """Orders as lines of a CSV file of past outcomes, some without a number or a team, read by the contract."""
    codes = F.array(*[F.lit(c) for c in ("HOU", "la", "STL", "SD", "OAK", "PHO", "BAL1", "KC", " ne ", "", "LARD", "LARM")])
    pick = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise((F.col("o_orderkey") % 257 + 1).cast("string"))
    fields = [F.year("o_orderdate").cast("string"), F.get(codes, (F.col("o_custkey") % 12).cast("int")), (F.col("o_orderkey") % 7 + 1).cast("string"), pick, F.concat(F.lit('"Player, '), F.col("o_orderkey").cast("string"), F.lit('"'))]
    lines = t.orders.select(F.from_csv(F.concat_ws(",", *fields), F.lit("season string, team string, round string, pick string, pfr_name string")).alias("x")).select("x.*")
    rows = records.past_outcomes(lines, 1993, 1997)
    return rows.groupBy("draft_year", "team_abbrev").agg(F.count(F.lit(1)).alias("n"), F.min("overall_pick").alias("first_pick"), F.max("round_number").alias("last_round"))


@query(
    "SELECT l_orderkey % 1000 AS bucket, sum(l_quantity)::DOUBLE AS snaps, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, max_by(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def roster_once(t: Tables) -> DataFrame:
    """Rows taken in twice under one key count once, the latest one."""
    version = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    rows = ingest.once_per_player(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], version)
    return rows.groupBy((F.col("l_orderkey") % 1000).alias("bucket")).agg(F.sum("l_quantity").alias("snaps"), F.count(F.lit(1)).alias("n"))


_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query(
    rf"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS rank, link FROM (
        SELECT page_id, min(pos) AS pos, link FROM (SELECT page_id, i AS pos, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || h WHEN starts_with(h, '/') THEN {_ROOT} || h
            WHEN starts_with(h, '?') THEN regexp_replace(url, '[?#].*$', '') || h ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END AS link
          FROM (SELECT page_id, url, unnest(l) AS h, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) || ['next', '//cdn.example.com/th', '?page=th', 'mailto:th@example.com'] AS l FROM pages))
          WHERE contains(lower(h), 'th')) GROUP BY page_id, link)"""
)
def html_links(t: Tables) -> DataFrame:
    """Links of the pages, to which one of each other form is added."""
    more = "<A HREF='next'>n</A><a href=\"//cdn.example.com/th\">c</a><a class=x href='?page=th'>p</a><a href=mailto:th@example.com>m</a>"
    return html.links(t.pages.withColumn("html", F.concat("html", F.lit(more))), "page_id", "url", "html", "TH")


def _plain(tag: str) -> str:
    inner = rf"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1), '<[^>]+>', '', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        inner = f"replace({inner}, '{name}', '{sign}')"
    return f"nullif(trim({inner}), '')"


@query(
    rf"""SELECT page_id, title, CASE WHEN page_id % 2 = 0 THEN 'Ann Writer' END AS author, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2026-03-04 05:06:07' WHEN page_id % 3 = 1 THEN TIMESTAMP '2025-04-07' END AS published, NULL::TIMESTAMP AS updated,
        try_cast(nullif(regexp_extract(title, '\b(20\d\d)\b', 1), '') AS INT) AS draft_year FROM (SELECT page_id, coalesce({_plain('h1')}, {_plain('title')}, url) AS title FROM pages)"""
)
def html_meta(t: Tables) -> DataFrame:
    """Titles, authors and dates of the pages, to some of which meta tags are added."""
    from augury.sources.registry import SourceConfig

    k = F.col("page_id")
    author = F.when(k % 2 == 0, "<meta content='Ann Writer' name='author'>").otherwise("")
    date = F.when(k % 3 == 0, '<meta property="article:published_time" content="2026-03-04T05:06:07Z">').when(k % 3 == 1, "<META NAME=pubdate CONTENT='Apr 7, 2025'>").otherwise("")
    out = html.metadata(t.pages.withColumn("html", F.concat(author, date, "html")), "page_id", "url", "html", SourceConfig("any"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published", "updated")})


@query("SELECT (n_nationkey + 1)::INT AS slot, MAP {0: 'TEN', 1: 'SF', 2: 'NYJ'}[n_nationkey % 4] AS code, 1 AS round FROM nation WHERE n_nationkey % 4 < 3")
def scraped_order(t: Tables) -> DataFrame:
    """A page with a table of the order, one row per nation; each fourth has a link that no team has."""
    slugs = F.array(*map(F.lit, ("titans", "49ers", "jets", "nobody")))
    row = F.format_string("<tr class='r'><td> %d </td><td><img><a href=\"/nfl/%s\">x</a></td><td>-</td></tr>", F.col("n_nationkey") + 1, F.get(slugs, F.col("n_nationkey") % 4))
    rows = t.nation.agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    page = rows.select(F.concat(F.lit("<table><tr><td>9</td></tr></table><table class=\"full draft-board\"><tr><th>Pick</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    return html.order_table(page, "html")


@query(
    """SELECT page_id, pick::INT AS pick, team, name, position, school FROM pages LEFT JOIN (VALUES (0::BIGINT, 1, 'Titans', 'Cam Ward', 'QB', 'Miami'), (1, 2, 'Browns', 'Travis Hunter', 'WR/CB', NULL), (3, 12, 'New England', 'T.J. O''Neil', NULL, NULL),
       (4, 5, 'Seahawks', 'Jaxon Smith-Njigba', 'WR', 'Ohio State'), (6, 7, 'Tampa Bay', 'Al Poe', NULL, 'Texas A&M'), (7, 8, '49ers', 'José Peña', 'CB', 'Nuevo León')) v(id, pick, team, name, position, school) ON id = page_id % 8"""
)
def pick_lines(t: Tables) -> DataFrame:
    """Pages as single lines of an article, some of which are picks."""
    lines = ["1. Titans - Cam Ward, QB, Miami", " 2) Browns: Travis Hunter, WR/CB", "no line", "12 New England - T.J. O'Neil", "5. Seahawks - Jaxon Smith-Njigba, WR, Ohio State", "100. Titans - Cam Ward", "7- Tampa Bay - Al Poe, Texas A&M", "8. 49ers – José Peña, CB, Nuevo León"]
    line = F.get(F.array(*map(F.lit, lines)), (F.col("page_id") % len(lines)).cast("int"))
    return t.pages.select("page_id", X.pick_line(line).alias("x")).select("page_id", "x.*")


_TEAMS, _MEN, _PLACES, _SCHOOLS = ("49ers", "Seahawks", "New York Jets", "la rams", "Nobody"), ("Jaxon Smith-Njigba", "José Peña", "T.J. O'Neil", "Al Poe Jr."), ("de", "T", "QB", "nickel"), ("Ohio St.", "Ole Miss", "Texas A&M", "Nuevo León", "Miami-Ohio", "LSU")


@query(
    """SELECT page_id, k::INT AS pick, ['49ERS', 'SEAHAWKS', 'NEW YORK JETS', 'LA RAMS', 'NOBODY'][(page_id + k) % 5 + 1] AS team_label, ['SF', 'SEA', 'NYJ', 'LAR', NULL][(page_id + k) % 5 + 1] AS team, ['jaxon smithnjigba', 'josé peña', 'tj oneil', 'al poe'][(page_id + k * 3) % 4 + 1] AS name,
       ['EDGE', 'OT', 'QB', 'NICKEL'][(page_id * 5 + k) % 4 + 1] AS position, ['ohio state', 'mississippi', 'texas am', 'nuevo león', 'miamiohio', 'lsu'][(page_id // 2 + k) % 6 + 1] AS school
       FROM pages, range(1, 10) r(k)"""
)
def page_picks(t: Tables) -> DataFrame:
    """The picks of all pages, to each of which a list of nine is added, by the table function; labels made canonical."""
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), (at % len(names)).cast("int"))
    page = F.col("page_id")
    line = lambda k: F.concat(F.lit("<li>"), k.cast("string"), F.lit(". "), pick(_TEAMS, page + k), F.lit(" - "), pick(_MEN, page + k * 3), F.lit(", "), pick(_PLACES, page * 5 + k), F.lit(", "), pick(_SCHOOLS, F.floor(page / 2) + k), F.lit("</li>"))
    listed = F.concat(F.lit("<ol>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), line), ""), F.lit("</ol>"))
    pages = t.pages.select("page_id", F.concat("html", listed).alias("html"))
    picks = pages.lateralJoin(html.ExtractPicks(F.col("html").outer(), F.lit(html.MIN_PICKS), F.lit(False)))
    return picks.select(
        "page_id", "pick", F.upper("team").alias("team_label"), X.team_code(F.col("team"), team_aliases()).alias("team"), X.normalize(F.col("name")).alias("name"), X.position(F.col("position")).alias("position"), X.school(F.col("school")).alias("school"),
    )


@query(
    """WITH k AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 400))) AS taken FROM events GROUP BY user_id)
       SELECT user_id, CASE WHEN len(taken) > 0 THEN 'b' || substr(sha256(array_to_string(taken, '|')), 1, 10) ELSE '' END AS suffix,
       substr(CASE WHEN len(taken) > 0 THEN 'a-rather-long-name-of-a-prediction-that-is-kept_' || repeat('x', (user_id % 9)::INT) || '_b' || substr(sha256(array_to_string(taken, '|')), 1, 10) ELSE 'a-rather-long-name-of-a-prediction-that-is-kept_' || repeat('x', (user_id % 9)::INT) END, 1, 64) AS cache_type FROM k"""
)
def cache_keys(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 400, F.col("event_type"))).alias("taken"))
    suffix = X.board_suffix(F.col("taken"))
    base = F.concat(F.lit("a-rather-long-name-of-a-prediction-that-is-kept_"), F.repeat(F.lit("x"), (F.col("user_id") % 9).cast("int")))
    return rows.select("user_id", suffix.alias("suffix"), X.cache_type(base, suffix).alias("cache_type"))


@query("SELECT event_type, event_id, ts, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value < 100 AND event_type = 'click') UNION ALL SELECT event_type, event_id, ts, value FROM events WHERE value < 100 AND event_type = 'click'")
def replace_rows(t: Tables) -> DataFrame:
    """Rows of a subquery are taken out by their key, then put in again."""
    rows = t.events.select("event_type", "event_id", "ts", "value")
    some = rows.filter("value < 100 AND event_type = 'click'")
    return upserts.unseen(rows, some, ["event_id"]).unionByName(some)


@query(
    """SELECT page_id, 2026 AS draft_year, (1 + k // 3)::INT AS round_number, (k % 3 + 1)::INT AS pick_in_round, (k + 1)::INT AS overall_pick, ['SF', 'NYJ', 'LAR'][(page_id + k) % 3 + 1] AS team,
       CASE (page_id + k) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'José "Pepe" Peña ' || page_id WHEN 2 THEN 'Al Poe-Ray' ELSE 'D''André ' || k END AS name
       FROM pages, range(0, 6) r(k) WHERE (page_id + k) % 7 <> 6"""
)
def tracker_payloads(t: Tables) -> DataFrame:
    """Each page with the payload of a tracker: teams by long ids, picks in falling order, some not announced, some of a team that is not listed."""
    page = F.col("page_id")
    ident = lambda k: F.regexp_replace(F.md5(k.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    teams_ = F.concat_ws(",", *[F.concat(F.lit('{"id":"'), ident(F.lit(k)), F.lit(f'","nick":{{"en":"x{{}}"}},"abbreviation":"{code}"}}')) for k, code in enumerate(("SF", "NYJ", "LAR"))])

    def pick(k: Column) -> Column:
        team = F.when((page + k) % 7 == 6, F.lit("nobody")).otherwise(ident((page + k) % 3))
        pepe = F.concat(F.lit(r'{"id":1,"displayName":"José \"Pepe\" Peña '), page.cast("string"), F.lit('"}'))
        andre = F.concat(F.lit(r'{"displayName":"D' + "'" + r'André '), k.cast("string"), F.lit('","stats":{"a":{}}}'))
        spoken = [F.lit("null"), pepe, F.lit('{"person":{"displayName":"Al Poe-Ray"}}'), andre]
        whom = F.get(F.array(*spoken), ((page + k) % 4).cast("int"))
        return F.concat(F.lit('{"year":2026,"teamId":"'), team, F.lit('","prospect":'), whom, F.lit(',"pick":'), (k % 3 + 1).cast("string"), F.lit(',"round":'), (F.floor(k / 3) + 1).cast("string"), F.lit(',"overallPick":'), (k + 1).cast("string"), F.lit("}"))

    picks = F.array_join(F.transform(F.sequence(F.lit(5), F.lit(0)), pick), ",")
    made = F.concat(F.lit('{"teams":['), teams_, F.lit('],"picks":['), picks, F.lit(']},{"year":"none"}'))
    escaped = F.replace(F.replace(made, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    payload = F.concat("html", F.lit('<script>push("'), escaped, F.lit('")</script>'))
    return html.tracker(t.pages.select("page_id", payload.alias("payload")), "page_id", "payload")


_STYLED = """<div class='big headline'>Top <div>of <b>page</b></div> {}</div><section data-testid='headline'>Other <section>part</section> {}</section>
<p class='by-line'>Ann <p>Lee</p></p><span rel='author'>Bob</span><ul class='board'><li><th>1</th><td>49ers</td><td>Jaxon Smith-Njigba, WR, Ohio State</td><th>x</th></li></ul><div class='story'>{}</div>"""


@query(
    """SELECT page_id, slug AS source_slug, CASE slug WHEN 'styled' THEN 'Top of page ' || page_id ELSE 'Other part ' || page_id END AS title, CASE slug WHEN 'styled' THEN 'Ann Lee' ELSE 'Bob' END AS author,
       CASE slug WHEN 'styled' THEN 1 ELSE 8 END AS picks, CASE slug WHEN 'styled' THEN 'Jaxon Smith-Njigba' ELSE 'José Peña' END AS first_name, CASE slug WHEN 'styled' THEN 'WR' ELSE 'CB' END AS first_position, NULL::VARCHAR AS reason
       FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'styled' ELSE 'marked' END AS slug FROM pages)"""
)
def source_pages(t: Tables) -> DataFrame:
    """The pages as those of two sources with selectors of their own, each with an elaborate end that both can read."""
    styled = SourceConfig("styled", titles=(".missing", "div.headline"), authors=("p.by-line",), rows=(".nothing tr", "ul.board li"))
    marked = SourceConfig("marked", titles=("[data-testid='headline']",), authors=(".by-nobody", "[rel='author']"), rows=(".nothing",), bodies=(".nobody", ".story"))
    lines = "".join(f"{k}. Rams – José Peña, CB\n" for k in range(1, 9))
    number = F.col("page_id").cast("string")
    a, b, c, d = _STYLED.split("{}")
    end = F.concat(F.lit(a), number, F.lit(b), number, F.lit(c + lines + d))
    slug = F.when(F.col("page_id") % 2 == 0, "styled").otherwise("marked")
    rows = articles.parsed(t.pages.select(slug.alias("source_slug"), F.concat_ws("#", "url", number).alias("url"), F.concat("html", end).alias("html")), F.lit(2026), (styled, marked))
    page = F.regexp_extract("article_url", "#([0-9]+)$", 1).cast("long").alias("page_id")
    return rows.select(page, "source_slug", "title", "author", F.size("picks").alias("picks"), F.col("picks")[0]["player_name"].alias("first_name"), F.col("picks")[0]["position"].alias("first_position"), "reason")
