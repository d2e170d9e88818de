"""Labels, pages, record files, articles and jobs, by cases."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from augury.functions import text as X
from augury.functions.teams import TEAMS, team_aliases, teams
from augury.operators import ingest
from augury.sources import articles, html, records, registry, selectors


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id int, x {kind}")


def test_line_parts_and_pick_line_agree(spark):
    rng = random.Random(1)
    pieces = ["1", "a", "B", " ", "-", ":", ",", ".", "'", "&", "/", "Ward", " - ", ": ", ", ", "QB", ")", "é", "–", " — ", "49ers", "José", "e\u0301", "日本"]
    lines = [rng.choice(["1. ", "12 ", "3) ", "4- ", ""]) + "".join(rng.choice(pieces) for _ in range(rng.randint(2, 12))) for _ in range(4000)]
    for strict in (False, True):
        got = {r.id: r.p for r in column(spark, lines).select("id", X.pick_line(F.col("x"), strict).alias("p")).collect()}
        assert sum(p.pick is not None for p in got.values()) > 10
        for k, line in enumerate(lines):
            assert tuple(got[k]) == (X.line_parts(line, strict) or (None,) * 5), line


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("5. Seahawks: Jaxon Smith-Njigba, WR, Ohio State", (5, "Seahawks", "Jaxon Smith-Njigba", "WR", "Ohio State")),
        ("7- Tampa Bay - Al Poe, Texas A&M", (7, "Tampa Bay", "Al Poe", None, "Texas A&M")),
        ("3: St. John's - D'Andre O'Neil, S, Miami-Ohio", (3, "St. John's", "D'Andre O'Neil", "S", "Miami-Ohio")),
        ("123. Titans - Cam Ward", None),
        ("4. 49ers - Cam Ward", (4, "49ers", "Cam Ward", None, None)),
        ("5. Seahawks - Jaxon Smith-Njigba, WR, Ohio State", (5, "Seahawks", "Jaxon Smith-Njigba", "WR", "Ohio State")),
        ("6. Rams – José Ramírez-Peña, CB, Nuevo León", (6, "Rams", "José Ramírez-Peña", "CB", "Nuevo León")),
        ("8. Jets-Al Poe", (8, "Jets", "Al Poe", None, None)),
        ("8. Jets-Al Poe-Ray", None),
        ("4. Titans - Cam Ward, QB, Miami, more", None),
    ],
)
def test_lines_by_class_of_character(line, want):
    assert X.line_parts(line) == want


def test_the_strict_mode_takes_the_last_dash_and_ascii_letters():
    assert X.line_parts("5. Seahawks - Jaxon Smith-Njigba, WR, Ohio State", True) == (5, "Seahawks - Jaxon Smith", "Njigba", "WR", "Ohio State")
    assert X.line_parts("4. 49ers - Cam Ward", True) is None is X.line_parts("6. Rams - José Peña", True)
    cell = "<table><tr><td>1</td><td>49ers</td><td>Jaxon Smith-Njigba, WR, Ohio State</td></tr></table>"
    assert html.picks_of(cell) == [(1, "49ers", "Jaxon Smith-Njigba", "WR", "Ohio State")]
    assert html.picks_of(cell, strict=True) == [(1, "49ers", "Jaxon Smith", "Njigba", "WR")]


def test_dates(spark):
    cases = {
        "2026-03-04": "2026-03-04 00:00:00", "Apr 7, 2025": "2025-04-07 00:00:00", "November 30, 2024": "2024-11-30 00:00:00", "2023-01-02T03:04:05": "2023-01-02 03:04:05",
        "2023-01-02T03:04:05Z": "2023-01-02 03:04:05", "2023-01-02T03:04:05.25+02:00": "2023-01-02 01:04:05.25", "2023-01-02 03:04": "2023-01-02 03:04:00",
        "posted 2022-09-09 late": "2022-09-09 00:00:00", "on Sep  9, 2022 at": "2022-09-09 00:00:00", "1999": None, "none": None,
    }
    got = column(spark, cases).select("x", X.any_date(F.col("x")).cast("string").alias("d")).collect()
    assert {r.x: r.d for r in got} == cases


def test_links_are_joined_as_the_standard_says(spark):
    bases = ["http://a.example.com/b/c/d?q#f", "https://x.org", "https://x.org/", "http://x.org/p/"]
    hrefs = ["g", "./g", "g/", "/g", "//h.com/x", "?y", "g?y", "#s", "", "..", "../g", "../../../g", "./../g", "g/./h", "g/../h", "mailto:a@b.c", "http://z.net/q", "/a/../b?c#d"]
    pairs = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", html.resolve(F.col("b"), F.col("h")).alias("r")).collect()
    assert {(r.b, r.h): r.r for r in got} == {(b, h): urljoin(b, h) for b, h in pairs}


def test_anchors_in_any_spelling(spark):
    page = """<A HREF='/Mock-Draft/1'>x</A><a class=b href=/mock-draft/2>y</a><a href="/mock-draft/2">again</a><a name=z>no</a><a href="/other&amp;mock-draft">z</a>"""
    got = html.links(spark.createDataFrame([(1, "http://s.com/l", page)], "id int, url string, html string"), "id", "url", "html", "mock-draft").collect()
    assert [r.link for r in sorted(got, key=lambda r: r.rank)] == ["http://s.com/Mock-Draft/1", "http://s.com/mock-draft/2", "http://s.com/other&mock-draft"]


def test_metadata_by_selectors(spark):
    pages = [
        (1, "u1", "<title>T</title><meta content='Ann' name='author'><meta property=\"article:published_time\" content=\"2026-03-04T05:06:07Z\"><h1>Mock <b>Draft</b> 2026</h1>"),
        (2, "u2", "<title> Only &amp; title </title><span class='by author x'>Bob <i>B</i></span><time datetime='x'>Apr 7, 2025</time>"),
        (3, "u3", "<p>nothing</p><span class='authors'>not this</span>"),
    ]
    got = {r.id: r for r in html.metadata(spark.createDataFrame(pages, "id int, url string, html string"), "id", "url", "html", registry.SourceConfig("any")).collect()}
    assert (got[1].title, got[1].author, str(got[1].published), got[1].draft_year) == ("Mock Draft 2026", "Ann", "2026-03-04 05:06:07", 2026)
    assert (got[2].title, got[2].author, str(got[2].published), got[2].updated is not None) == ("Only &amp; title", "Bob B", "2025-04-07 00:00:00", True)
    assert (got[3].title, got[3].author, got[3].published, got[3].draft_year) == ("u3", None, None, None)
    assert html.metadata(spark.createDataFrame(pages, "id int, url string, html string"), "id", "url", "html", registry.SourceConfig("any"), 2030).first().draft_year == 2030


def test_picks_by_strategy():
    table = "<table><tr><th>#</th></tr><tr><td>1</td><td>Titans</td><td>Cam Ward - QB - Miami</td></tr><tr><td>2</td><td>Browns</td><td>Solo</td></tr></table>"
    assert html.picks_of(table) == [(1, "Titans", "Cam Ward", "QB", "Miami"), (2, "Browns", "Solo", None, None)]
    items = "".join(f"<li>{k}. Jets - Al Poe, QB</li>" for k in range(1, 9))
    assert len(html.picks_of(f"<ol>{items}</ol>")) == 8 and html.picks_of(f"<ol>{items[:100]}</ol>") == []
    lines = "".join(f"<p>{k}. Jets - Al Poe-Ray, QB, Ohio State</p>" for k in range(1, 10))
    assert len(html.picks_of(f"<body><nav>{lines}</nav><article>{lines}</article></body>")) == 9
    assert html.picks_of(f"<body><script>{lines}</script></body>") == [] == html.picks_of(None)


def brute_select(page, selector):
    """The texts of what a selector finds, by walking a tree made with another parser."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(f"<root>{page}</root>")
    parents = {c: p for p in root.iter() for c in p}

    def fits(e, simple):
        tag, classes, attributes = simple.tag, simple.classes, simple.attributes
        return (tag is None or e.tag == tag) and classes <= set(e.get("class", "").split()) and all(n in e.attrib and (v is None or e.get(n) == v) for n, v in attributes)

    def chained(e, chain):
        if not fits(e, chain[-1]):
            return False
        rest, up = chain[:-1], parents.get(e)
        while rest and up is not None:
            if fits(up, rest[-1]):
                rest = rest[:-1]
            up = parents.get(up)
        return not rest

    return ["".join(e.itertext()).strip() for e in root.iter() if e is not root and any(chained(e, c) for c in selectors.compiled(selector))]


def test_selectors_equal_a_walk_over_the_tree():
    rng = random.Random(11)
    tags, classes = ["div", "p", "li", "ol", "section", "h1"], ["a", "b", "head-line", "a b"]

    def node(depth):
        tag = rng.choice(tags)
        attributes = (f' class="{rng.choice(classes)}"' if rng.random() < 0.5 else "") + (f' rel="{rng.choice("xy")}"' if rng.random() < 0.3 else "")
        inner = "".join(node(depth - 1) if rng.random() < 0.6 else rng.choice(["text ", "t", " "]) for _ in range(rng.randint(0, 3))) if depth else "leaf"
        return f"<{tag}{attributes}>{inner}</{tag}>"

    asked = ["div", ".a", "p.a", "[rel]", "[rel='x']", "li.b[rel=y]", "ol li", "section .a p", "div div", "h1, .head-line", "section  [rel='y'] , ol p.b", "*"]
    for _ in range(150):
        page = "".join(node(5) for _ in range(rng.randint(1, 3)))
        matcher = selectors.Matcher({"first": tuple(asked)}, {"every": tuple(asked)})
        found = matcher.read(page)
        for k, selector in enumerate(asked):
            want = brute_select(page, selector)
            got = [e.text() for e in found.get(("every", k), [])]
            if "," in selector:  # an element that two alternatives find is listed for each
                assert set(got) == set(want)
            else:
                assert got == want
                assert [e.text() for e in found.get(("first", k), [])] == want[:1]
    for wrong in ("", "p >", "a:hover", "p, "):
        with pytest.raises(ValueError, match="not a selector"):
            selectors.compiled(wrong)


def test_each_source_has_its_own_selectors(spark):
    lines = "".join(f"<p>{k}. 49ers - Al Poe-Ray, QB</p>" for k in range(1, 10))
    nested = "<table><tr><td>1</td><td>Jets</td><td>Ann Lee, QB<table><tr><td>9</td></tr></table></td></tr></table>"
    pages = [
        ("espn", "u1", f"<title>T</title><div class='x headline'>Mock <div>Draft</div> 2026</div><span class='author-name'>Ann</span><div class='article-body'>{lines}</div>"),
        ("yahoo", "u1", f"<title>T</title><div class='headline'>Mock <div>Draft</div> 2026</div><div role='article'>{lines}</div>"),
        ("pfn", "u2", f"<title> Only &amp; </title><article><header><h1>Head 2027</h1></header></article><time datetime='x'>Apr 7, 2025</time>{nested}"),
        ("other", "u3", "<h1></h1><ol><li>0. Jets - Al Poe</li>" + "<li>2. Jets - Al Poe</li>" * 7 + "</ol>"),
        ("espn", "u4", None),
    ]
    rows = {(r.source_slug, r.article_url): r for r in articles.parsed(spark.createDataFrame(pages, "source_slug string, url string, html string"), F.lit(2030)).collect()}
    espn, yahoo, pfn = rows["espn", "u1"], rows["yahoo", "u1"], rows["pfn", "u2"]
    assert (espn.title, espn.author, espn.draft_year, len(espn.picks), espn.reason) == ("Mock Draft 2026", "Ann", 2026, 9, None)
    assert (yahoo.title, yahoo.author, yahoo.draft_year, len(yahoo.picks)) == ("T", None, 2030, 9)
    assert espn.picks[0].player_name == "Al Poe-Ray" and espn.picks[0].original_team == "49ers"
    assert (pfn.title, str(pfn.published), pfn.draft_year, pfn.picks[0].player_name) == ("Head 2027", "2025-04-07 00:00:00", 2027, "Ann Lee")
    assert (rows["other", "u3"].title, rows["other", "u3"].reason) == ("u3", registry.BAD_NUMBER)
    assert (rows["espn", "u4"].title, rows["espn", "u4"].reason) == ("u4", registry.NO_PICKS)


def test_links_by_each_source_s_keyword(spark):
    page = "<a href='/mock/1'>a</a><a href='/mock-draft/2'>b</a><a href='/news'>c</a>"
    rows = [(s, "https://e.com/x", page) for s in ("espn", "nfl-com", "manual", "nobody")]
    got = articles.discovered(spark.createDataFrame(rows, "source_slug string, url string, html string")).collect()
    assert sorted(map(tuple, got)) == [("espn", 0, "https://e.com/mock/1"), ("espn", 1, "https://e.com/mock-draft/2"), ("nfl-com", 0, "https://e.com/mock-draft/2")]


def test_parsers_and_registry():
    assert registry.build_parser("espn", "html_static").picks("<p>x</p>") == []
    assert registry.build_parser("nobody", "html_dynamic").picks("<table><tr><td>1</td><td>a</td><td>b</td></tr></table>") == []
    for kind in ("rss", "manual_upload"):
        with pytest.raises(ValueError):
            registry.build_parser("espn", kind)
    parser = registry.build_parser("espn", "html_static")
    for picks in ([], [(0, "a", "b", None, None)]):
        with pytest.raises(ValueError):
            parser.validate(picks)
    known = registry.Registry()
    for s in registry.SOURCES:
        known.register(s)
    known.register(registry.SourceConfig("espn", active=False))
    assert len(known.active()) == 8 and "manual" not in [s.slug for s in known.automated()]


def test_order_table_staff_and_mock_board(spark):
    page = "<table class='draft-board'>" + "".join(f"<tr><td>{k}</td><td><a href='/x/{s}'>t</a></td></tr>" for k, s in ((1, "titans"), (2, "nobody"), (3, "Jets"), (1, "bears"))) + "<tr><td>x</td></tr></table>"
    got = html.order_table(spark.createDataFrame([(page,)], "html string"), "html").collect()
    assert sorted(map(tuple, got)) == [(1, "CHI", 1), (3, "NYJ", 1)]
    box = "<strong>Coach:</strong> <a href='x'>Ann Lee</a>"
    meta = '<meta name="d" content="Coach: Bo Ray">'
    pages = spark.createDataFrame([(1, box, meta), (2, "", meta), (3, None, None)], "id int, a string, b string")
    assert [r.coach for r in html.staff_of(pages, "id", "a", "b", {"coach": "Coach"}).orderBy("id").collect()] == ["Ann Lee", "Bo Ray", None]
    anchors = spark.createDataFrame([(k, f"Name {chr(65 + k % 26)}{'x' * (k // 26)} QB | School") for k in range(40)], "pos int, text string")
    order = spark.createDataFrame([(k, f"T{k}", 1) for k in range(1, 33)], "slot int, team string, round int")
    board = html.mock_board(anchors, "pos", "text", order).collect()
    assert len(board) == 32 and {(r.slot, r.team) for r in board} == {(k, f"T{k}") for k in range(1, 33)}
    assert html.mock_board(anchors.limit(31), "pos", "text", order).isEmpty() and html.mock_board(anchors, "pos", "text", order.limit(31)).isEmpty()


def test_resolver_steps(spark):
    cases = {
        "TEN": "TEN", "ten": "TEN", " n.e. ": "NE", "jets": "NYJ", "from the Tennessee Titans (via Chicago)": "TEN", "Los Angeles": None, "los angeles rams": "LAR",
        "Green Bay": "GB", "standard": None, "xjets": None, "Jets or Giants": "NYG", "niners": "SF", "": None, "  ": None, None: None, "Washington Football Team!": "WAS",
    }
    got = ingest.resolve_teams(column(spark, cases), "x", teams(spark)).collect()
    code = {k: c for k, (c, _, _) in enumerate(TEAMS, 1)}
    assert len(got) == len(cases) and {r.x: code.get(r.team_id) for r in got} == cases
    own = spark.createDataFrame([(1, "AAA", "Port Vale United", "Port Vale"), (2, "BBB", "Rovers", "Twin"), (3, "CCC", "City", "Twin")], "team_id long, code string, name string, city string")
    got = ingest.resolve_teams(column(spark, ["port vale united", "Port Vale", "twin", "bbb"]), "x", own).collect()
    assert {r.x: r.team_id for r in got} == {"port vale united": 1, "Port Vale": 1, "twin": None, "bbb": 2}


def test_aliases_are_the_normalised_labels(spark):
    got = column(spark, list(team_aliases())).select("x", X.normalize(F.col("x")).alias("n")).collect()
    assert all(r.x == r.n for r in got) and len(got) == len(team_aliases())


PICKS = "array<struct<overall_pick:int,round_number:int,original_team:string,current_team:string,traded:boolean,player_name:string,position:string,school:string>>"


def test_ingest_twice_and_again_with_better_teams(spark):
    schema = f"source_slug string, article_url string, title string, draft_year int, published timestamp, picks {PICKS}"
    row = lambda slug, url, year, *labels: (slug, url, "t", year, None, [(k, 1, None, label, False, "Al Poe Jr.", "de", "Ohio St.") for k, label in labels])
    first = spark.createDataFrame([row("espn", "u1", 2026, (1, "nobody"), (1, "jets"), (2, "bears")), row("espn", "u1", 2026, (1, "nobody"), (1, "jets"), (2, "bears")), row("who", "u2", 2026, (1, "x")), row("espn", "u3", 1900, (1, "x"))], schema)
    sources, cycles = records.sources(spark), records.calendar(spark)
    articles = spark.createDataFrame([], "source_slug string, article_url string, content_hash string, title string, draft_year int, published timestamp")
    picks = ingest.picks_of(ingest.with_key(first.limit(0)), teams(spark))
    a, p, bad = ingest.ingest(first, articles, picks, sources, cycles, teams(spark))
    assert a.count() == 1 and p.count() == 3 and sorted(r.reason for r in bad.collect()) == ["unknown source", "unknown year"]
    assert {(r.player, r.position, r.school) for r in p.collect()} == {("al poe", "EDGE", "ohio state")}
    assert sorted(str(r.current_team_id) for r in p.collect()) == ["25", "6", "None"]
    better = spark.createDataFrame([row("espn", "u1", 2026, (1, "Tennessee"), (2, "bears"), (3, "jets"))], schema)
    a, p, bad = ingest.ingest(better, a, p, sources, cycles, teams(spark))
    assert a.count() == 1 and bad.isEmpty()
    assert sorted((r.overall_pick, r.current_team_id) for r in p.collect()) == [(1, 31), (1, 31), (2, 6)]


def test_record_contracts(spark):
    raw = spark.createDataFrame([("1", "2", "", "TEN", "TRUE", "Al", "", None), ("1", "x", None, None, "yes", "Bo", "QB", "LSU")], "round_number string, overall_pick string, original_team string, current_team string, traded string, player_name string, position string, school string")
    assert sorted((r.overall_pick, r.traded, r.original_team) for r in records.manual_picks(raw).collect() if r.overall_pick) == [(2, True, None)]
    assert [r.traded for r in records.manual_picks(raw.drop("traded")).collect()] == [False, False]
    upstream = spark.createDataFrame([("1995", "HOU", "1", "3", " A "), ("2002", "HOU", "1", "4", "B"), ("x", "KC", "1", "5", "C"), ("2003", "STL", "1", "", "D"), ("2004", "stl", "2", "40", "E")], "season string, team string, round string, pick string, pfr_name string")
    assert sorted(map(tuple, records.past_outcomes(upstream, max_year=2003).collect())) == [(1995, 1, 3, "TEN", "A"), (2002, 1, 4, "HOU", "B")]
    with pytest.raises(ValueError, match="pfr_name"):
        records.past_outcomes(upstream.drop("pfr_name"))
    order = spark.createDataFrame([("1", "", "ten"), ("2", "3", "SF"), ("2", None, "NYJ"), ("4", "1", "XXX")], "overall_pick string, round_number string, team_abbreviation string").coalesce(1)
    assert sorted(map(tuple, records.draft_order(order, teams(spark)).collect())) == [(1, 1, 31), (2, 1, 25)]
    assert records.draft_order(order.drop("round_number"), teams(spark)).count() == 2


def test_digests(spark):
    rows = spark.createDataFrame([(["b", "a", " a "], [("x", "QB", 1), ("y", None, None)]), ([], [("y", None, None), ("x", "QB", 1)])], "t array<string>, c array<struct<player_name:string,position:string,consensus_rank:int>>")
    a, b = rows.select(X.board_suffix(F.col("t")).alias("s"), X.candidate_signature(F.col("c")).alias("c")).collect()
    import hashlib

    assert a.s == "b" + hashlib.sha256(b"a|b").hexdigest()[:10] and b.s == "" and a.c == b.c and len(a.c) == 64
    assert spark.range(1).select(X.cache_type(F.lit("p" * 60), F.lit("b12345")).alias("k")).first().k == "p" * 60 + "_b12"
