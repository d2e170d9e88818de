"""Expected values of FIXTURES.md, section 3, on inline rows."""

import math

import pytest
from pyspark.sql import functions as F

from augury.functions import scores as S
from augury.functions import text as X
from augury.functions.teams import TEAMS, team_aliases
from augury.operators import candidates, consensus, models, needs, probs
from augury.sources import html


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def smooth(spark, values, pool=0):
    rows = spark.createDataFrame(list(values.items()), "name string, v double")
    k, total = max(len(values) + 1, pool), sum(values.values())
    got = {r.name: r.p for r in rows.select("name", S.smoothed(F.col("v"), F.lit(total), F.lit(k)).alias("p")).collect()}
    return k, got, one(spark, o=S.smoothed_other(F.lit(total), F.lit(len(values)), F.lit(k))).o


def test_dirichlet(spark):
    k, p, other = smooth(spark, {"alice": 10.0})
    assert k == 2 and p["alice"] == pytest.approx(0.9545454545) and other == pytest.approx(0.0454545455)
    k, p, other = smooth(spark, {"alice": 1.0}, 12)
    assert k == 12 and p["alice"] == pytest.approx(0.2142857143) and other == pytest.approx(0.7857142857)
    k, p, other = smooth(spark, {"a": 5.0, "b": 5.0})
    assert k == 3 and p["a"] == p["b"] == pytest.approx(0.4782608696) and other == pytest.approx(0.0434782609)


def test_pools(spark):
    slots = spark.createDataFrame([(s,) for s in (1, 6, 7, 8, 16, 32, 50, 257)], "s int")
    assert [r.p for r in slots.select(S.slot_pool(F.col("s")).alias("p")).collect()] == [6, 6, 6, 7, 11, 19, 28, 28]
    cases = {(1, 1, 1, 1, 40): 14, (1, 4, 2, 4, 1): 9, (1, 5, 1, 5, 40): 5, (1, 6, 2, 6, 1): 5, (1, 7, 1, 7, 40): 4, (1, 10, 2, 10, 8): 2, (1, 12, 3, 12, 1): 2, (1, 30, 1, 30, 100): 2, (2, 4, 2, 4, 1): 10, (3, 40, 3, 30, 9): 4}
    rows = spark.createDataFrame(list(cases), "m long, n long, src long, arts long, ep int").coalesce(1)
    got = rows.select(S.evidence_pool(*[F.col(c) for c in ("m", "n", "src", "arts", "ep")]).alias("k")).collect()
    assert [r.k for r in got] == list(cases.values())


def test_decay_and_age(spark):
    assert one(spark, x=S.decay(F.lit(14.0), F.lit(14.0))).x == pytest.approx(0.3678794412)
    at = lambda t: F.lit(t).cast("timestamp")
    got = one(spark, a=S.age_days(at("2024-01-01 23:00:00"), at("2024-01-02 01:00:00")), b=S.age_days(at("2024-01-03"), at("2024-01-02")), c=S.age_days(at("2024-01-01"), at("2024-01-03")))
    assert tuple(got) == (0.0, 0.0, 2.0)


def test_text(spark):
    values = ["Will Johnson Jr.", "  T.J.  Watt II ", "John Jr Smith", "Ohio St.", "A  B", None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = [r.n for r in rows.select("k", X.normalize(F.col("v")).alias("n")).orderBy("k").collect()]
    assert got == ["will johnson", "tj watt", "john  smith", "ohio st", "a b", None]
    aliases = team_aliases()
    assert len(TEAMS) == 32 and aliases["jets"] == "NYJ" and aliases["green bay"] == "GB" and "new york" not in aliases
    got = one(spark, a=X.position(F.lit("de")), b=X.school(F.lit("Ohio St.")), c=X.team_code(F.lit("jets"), aliases), d=X.team_code(F.lit("New York Jets"), aliases), e=X.team_code(F.lit("Los Angeles"), aliases))
    assert tuple(got) == ("EDGE", "ohio state", "JETS", "NYJ", None)
    blob = one(spark, a=X.blob_parts(F.lit("Ann Lee - QB | Yale")), b=X.blob_parts(F.lit("Ann Lee-Ray, QB"), False))
    assert tuple(blob.a) == ("Ann Lee", "QB", "Yale") and tuple(blob.b) == ("Ann Lee-Ray", "QB", None)


def test_candidate_and_need_formulas(spark):
    lit = F.lit
    got = S.need_scores(lit(1200.0), lit(18.0), lit(28.5), lit(2.0), lit(2.0), lit(0.2), lit(0.4))
    row = one(spark, **{k: got[k] for k in ("short_term", "long_term", "overall")})
    assert tuple(row) == pytest.approx((0.6847955182, 0.575, 0.6353875350))
    row = one(spark, a=S.dampened_need(lit(0.9), lit(1.0)), b=S.dampened_need(lit(0.9), lit(0.0)), c=S.override(lit(0.2), lit(0.95), lit(0.7)), d=S.override(lit(0.9), lit(0.95), lit(0.7)), e=S.capacity(lit("qb")), f=S.capacity(lit("XX")))
    assert tuple(row) == pytest.approx((0.252, 0.9, 0.9428571429, 0.1178571429, 1100.0, 1600.0))
    cand = spark.createDataFrame([(1, "a", "CB", 0.9, 0.9, 1), (5, "b", "OT", 0.82, 0.8, 5)], "candidate_id long, name string, position string, prospect double, star double, consensus_rank long")
    row = candidates.features(cand, spark.createDataFrame([("T", "OT", 0.75)], "team string, position string, need double")).filter("candidate_id = 5").first()
    assert (row.gap_best, row.fit_gap, row.need_vs_bpa) == pytest.approx((4.0, 0.07, -0.07))


def test_priors_of_the_fixture(spark):
    names = "gm_offense coach_offense org_offense gm_trenches coach_trenches org_trenches gm_need org_need gm_bpa org_bpa stability".split()
    row = one(spark, **S.priors({n: F.lit(None).cast("double") for n in names}))
    assert set(row) == {0.5}


TOPS = {
    "OT": {"EDGE": 0.3636, "CB": 0.2727, "OT": 0.1818, "WR": 0.1818},
    "EDGE": {"OT": 0.3636, "CB": 0.2727, "EDGE": 0.1818, "WR": 0.1818},
    "CB": {"OT": 0.3333, "EDGE": 0.3333, "CB": 0.1667, "WR": 0.1667},
    "WR": {"OT": 0.3333, "EDGE": 0.3333, "CB": 0.25, "WR": 0.0833},
    "QB": {"QB": 0.4091, "OT": 0.1818, "EDGE": 0.1818, "CB": 0.1364, "WR": 0.0909},
}


def test_default_vectors_and_guard(spark):
    rows = spark.createDataFrame([(t, t, 0.9) for t in TOPS], "id string, top string, top_need double")
    got = probs.default_vector(rows, ["id"], "top")
    by = {t: {r.label: round(r.prob, 4) for r in got.filter(F.col("id") == t).collect()} for t in TOPS}
    assert by == TOPS
    guarded = {r.label: round(r.prob, 4) for r in probs.guard(got, rows, ["id"]).filter("id = 'OT'").collect()}
    assert guarded == {"OT": 0.55, "EDGE": 0.2, "CB": 0.15, "WR": 0.1}


def test_evaluation_and_disagreement(spark):
    schema = "row_id int, label string, prob double"
    v = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.3), (2, "a", 0.4), (2, "b", 0.6), (3, "a", 1.0)], schema)
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "row_id int, label string")
    row = probs.evaluate({"m": v}, truth, "row_id").first()
    assert row.log_loss == pytest.approx(-(math.log(0.7) + math.log(0.4) + math.log(1e-12)) / 3) and (row.top1, row.top3) == pytest.approx((1 / 3, 2 / 3))
    lists = spark.createDataFrame([(["cam ward", "travis hunter", "will campbell"], ["travis hunter", "mason graham", "will campbell"]), ([], [])], "a array<string>, b array<string>").coalesce(1)
    got = [r.d for r in lists.select(candidates.compare(F.col("a"), F.col("b"))["disagreement"].alias("d")).collect()]
    assert got == pytest.approx([0.5, 0.0])


def test_next_slot_and_ladder(spark):
    board = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c"), (3, 1, "a"), (3, 2, "c")], "slot int, rank int, cand string")
    assert [(r.slot, r.cand) for r in consensus.ladder(board).orderBy("slot").collect()] == [(1, "a"), (2, "c"), (3, "a")]


def test_roster_strength_at_capacity(spark):
    roster = spark.createDataFrame([("A", "qb", 1100), ("A", "RB", 95)], "team string, position string, snaps long")
    need = spark.createDataFrame([("A", "QB", 0.9), ("A", "RB", 0.5), ("A", "WR", 0.4)], "team string, position string, overall double")
    got = {r.position: (r.strength, r.adjusted) for r in needs.adjusted(need, roster).collect()}
    assert got["QB"] == pytest.approx((1.0, 0.252)) and got["RB"] == pytest.approx((0.1, 0.464)) and got["WR"] == (0.0, 0.4)
    free = {r.position: r.adjusted for r in needs.adjusted(need, roster.limit(0)).collect()}
    assert free == {"QB": 0.9, "RB": 0.5, "WR": 0.4}


def test_html_picks_and_tracker(spark):
    table = "<h1>2026 Mock</h1><table><tr><th>#</th></tr><tr><td>1</td><td>Titans</td><td>Cam Ward, QB, Miami</td></tr><tr><td>2</td><td>Browns</td><td>Travis Hunter | CB</td></tr></table>"
    assert html.picks_of(table) == [(1, "Titans", "Cam Ward", "QB", "Miami"), (2, "Browns", "Travis Hunter", "CB", None)]
    items = "<ol>" + "".join(f"<li>{k}. Team - Name Here, QB</li>" for k in range(1, 3)) + "</ol>"
    assert html.picks_of(items) == [] and len(html.picks_of(items, 2)) == 2 and html.picks_of(None) == []
    pages = spark.createDataFrame([(1, table), (2, items)], "id int, html string")
    pages.createOrReplaceTempView("pick_pages")
    spark.udtf.register("extract_picks", html.ExtractPicks)
    got = spark.sql("SELECT id, p.* FROM pick_pages, LATERAL extract_picks(html, 2) p").collect()
    assert sorted((r.id, r.pick) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    a, b = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "0" * 12
    plain = f'{{"id":"{a}","abbreviation":"LV"}},{{"id":"{b}","abbreviation":"NYJ"}},{{"year":2026,"round":1,"pick":2,"overallPick":2,"teamId":"{b}","prospect":null}},{{"year":2026,"round":1,"pick":1,"overallPick":1,"teamId":"{a}","prospect":{{"displayName":"Fernando Mendoza"}}}}'
    assert html.tracker_picks(plain.replace('"', '\\"')) == [(1, 1, "LV", "Fernando Mendoza"), (2, 1, "NYJ", None)]


def test_models_on_the_fixture_sizes(spark):
    schema = "row int, top_need_position string, label_position string, need_score double, board_scarcity_score double, best_available_player_score double, overall_pick int, round_number int"
    rows = spark.createDataFrame([(1, "OT", "OT", 0.8, 0.5, 0.6, 1, 1), (2, "QB", "QB", 0.9, 0.4, 0.7, 2, 1), (3, "CB", "CB", 0.7, 0.3, 0.5, 3, 1)], schema)
    got = models.position_vectors(models.train_position(rows), rows, ["row"])
    for r in got.groupBy("row").agg(F.sum("prob").alias("s"), F.min("prob").alias("lo")).collect():
        assert r.s == pytest.approx(1.0) and r.lo >= 0


def test_prospects_and_staff(spark):
    rows = spark.createDataFrame([(1, "Cam Ward QB | Miami"), (2, "cam ward jr. QB | Miami"), (3, "no prospect"), (4, "Travis Hunter CB | Colorado")], "pos int, t string")
    got = html.prospects(rows, "pos", "t").orderBy("place").collect()
    assert [(r.name, r.position, r.school, r.place) for r in got] == [("Cam Ward", "QB", "Miami", 1), ("Travis Hunter", "CB", "Colorado", 2)]
    assert [r.prospect for r in got] == pytest.approx([1.0, 0.9])
    page = '<th>General manager</th><td> <a href="/x">Ann Lee</a></td><meta name="description" content="Coach: Bob Ray, since">'
    row = one(spark, a=html.staff(F.lit(page), "General manager"), b=html.staff(F.lit(page), "Coach"), c=html.staff(F.lit(page), "Owner"))
    assert tuple(row) == ("Ann Lee", "Bob Ray", None)
