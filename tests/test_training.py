"""The registry of models, training of all families, and the front door that uses them."""

import json

import pytest
from pyspark.sql import functions as F

from augury.api import Board
from augury.functions.teams import teams
from augury.operators import ingest, models, org
from augury.plans.queries import QUERIES
from augury.plans.tables import Tables
from augury.sources import records


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return {"votes": t.votes(), "outcomes": t.outcomes(), "order": t.order(), "roster": t.roster(), "needs": t.needs(), "candidates": t.candidates().filter("candidate_id < 60"), "org": t.org()}, t


@pytest.fixture(scope="module")
def trained(spark, tables, tmp_path_factory):
    t = tables[1]
    folder = tmp_path_factory.mktemp("registry")
    registry = models.Registry(spark, f"file://{folder}")
    assert registry.runs().isEmpty() and registry.model("player_model") is None
    roster = t.roster().withColumn("year", F.lit(2025))
    context = t.votes().filter("team IS NOT NULL").select(
        F.lit(2024).alias("cycle"), "team", F.col("cand").alias("label_position"), F.lit("ECONOMY").alias("top_need_position"), F.lit(0.5).alias("board_scarcity_score"),
        F.lit(0.4).alias("best_available_player_score"), F.col("slot").alias("overall_pick"), F.lit(1).alias("round_number"),
    )
    needs = t.needs().select(F.lit(2024).alias("cycle"), "team", "position", F.col("overall").alias("need"))
    from augury.plans.profiles import _player_rows

    features = _player_rows(t).filter("candidate_id < 60").withColumns({"year": F.lit(2024), "selected_label": F.col("prospect_score") > 0.3})
    out = models.train_all(registry, [2023, 2024, 2025], [2024, 2025], roster, context, needs, features, f"file://{folder}/needs")
    return registry, out, folder


def test_all_families_leave_a_run(spark, trained):
    registry, out, folder = trained
    assert not [v for v in out.values() if v.startswith("failed")] and set(out) == {"need_model", "position_model", "player_model", "org_prior_model", "integrated_team_model"}
    meta = {r.family: r for r in registry.metadata().collect()}
    assert set(meta) == set(out) and meta["player_model"].train_window == [2023, 2025] and meta["org_prior_model"].test_window == [None, None]
    assert json.loads(meta["need_model"].metrics)["scored_positions"] == spark.read.parquet(f"file://{folder}/needs").filter("year = 2025").count()
    assert "superstar_signal" in meta["player_model"].feature_groups and meta["org_prior_model"].feature_groups == ["unknown"]


def test_one_family_s_fault_keeps_no_other_back(spark, trained, tables, tmp_path):
    registry = models.Registry(spark, f"file://{tmp_path}")
    empty = spark.createDataFrame([], "cycle int, team string, label_position string, top_need_position string, need double, position string, year int")
    roster = tables[1].roster().withColumn("year", F.lit(2025))
    out = models.train_all(registry, [2025], [], roster, empty, empty, empty)
    assert out["position_model"].startswith("failed") and out["player_model"].startswith("failed") and out["need_model"].endswith("2025") and out["org_prior_model"] == "org-prior-v1"
    with pytest.raises(ValueError):
        models.train_all(registry, [], [], roster, empty, empty, empty)


def test_the_board_asks_the_models(tables, trained):
    board = Board(tables[0], tables[1].as_of, trained[0])
    plain = Board(tables[0], tables[1].as_of)
    for r in board.position_vectors(3).groupBy("team").agg(F.sum("prob").alias("p"), F.count("label").alias("n")).collect():
        assert r.p == pytest.approx(1.0) and r.n == 25
    assert {r.label for r in plain.position_vectors().collect()} != {r.label for r in board.position_vectors().collect()}
    asked = board.player_probabilities().filter("team = 'NATION_1'").collect()
    assert len(asked) == 24 and all(0 <= r.probability <= 1 for r in asked)
    assert [r.probability for r in asked] != [r.probability for r in plain.player_probabilities().filter("team = 'NATION_1'").collect()]
    assert board.model_metadata().count() == 5
    with pytest.raises(KeyError):
        plain.model_metadata()
    for r in board.org_player_vectors().groupBy("team").agg(F.sum("adjusted").alias("p")).collect():
        assert r.p == pytest.approx(1.0)


def test_board_aware_flags(tables):
    t = tables[1]
    rows = {r.slot: r for r in Board(tables[0], t.as_of).pick_consensus(top_n=1, board_aware=True).collect()}
    first = min(r.slot for r in t.outcomes().collect())
    assert rows[first].board_aware is False and rows[first].excluded is None and rows[7].board_aware and rows[7].excluded >= 0
    nobody = Board(tables[0] | {"outcomes": t.outcomes().limit(0)}, t.as_of).pick_consensus(top_n=1, board_aware=True).collect()
    assert nobody and not any(r.board_aware for r in nobody) and all(r.excluded is None for r in nobody)
    assert Board(tables[0], t.as_of).pick_consensus(2, 1).first().excluded is None


def test_writes_through_the_board(spark, tables):
    t = tables[1]
    empty = spark.createDataFrame([], "source_slug string, article_url string, content_hash string, title string, draft_year int, published timestamp")
    more = {"articles": empty, "sources": records.sources(spark), "cycles": records.calendar(spark), "teams": teams(spark)}
    more["picks"] = ingest.picks_of(spark.createDataFrame([], f"source_slug string, article_url string, content_hash string, draft_year int, picks {__import__('augury.sources.html').sources.html._PICKS}"), teams(spark))
    board = Board(tables[0] | more, t.as_of)
    lines = "".join(f"<li>{k}. Jets - Al Poe{chr(96 + k)}, QB</li>" for k in range(1, 9))
    pages = spark.createDataFrame([("http://e.com/1", f"<h1>Mock 2026</h1><ol>{lines}</ol>"), ("http://e.com/2", "<p>no picks</p>"), ("http://e.com/3", f"<h1>Old 2099</h1><ol>{lines}</ol>")], "url string, html string")
    rejected = {r.article_url: r.reason for r in board.ingest_pages(pages, "espn").collect()}
    assert rejected == {"http://e.com/2": "no picks were found", "http://e.com/3": "unknown year"}
    assert board["articles"].count() == 1 and {r.current_team_id for r in board["picks"].collect()} == {25}
    with pytest.raises(ValueError):
        board.ingest_pages(pages, "manual")
    more_pages = pages.selectExpr("'espn' AS source_slug", "concat(url, 'x') AS url", "row_number() OVER (ORDER BY url) - 1 AS place", "html")
    audit = {r.source_slug: r for r in board.run_ingestion(more_pages, ["espn", "yahoo", "manual"]).collect()}
    assert (audit["espn"].discovered, audit["espn"].parsed, audit["espn"].errors, audit["espn"].status) == (3, 1, 2, "partial")
    assert audit["yahoo"].status == "success" and audit["manual"].status == "skipped" and set(audit) == {"espn", "yahoo", "manual"}
    assert board["articles"].count() == 2
    n = board["outcomes"].count()
    board.add_outcome(12, "Al Poe Jr.")
    assert board["outcomes"].count() == n + 1 and board["outcomes"].filter("slot = 12").first().cand == "al poe"
    known = Board(tables[0] | {"teams": spark.createDataFrame([("NATION_3",)], "code string")}, t.as_of)
    known.put_order(spark.createDataFrame([(2, 1, "nation_3"), (99, 5, "NATION_3")], "slot int, round int, team string"))
    assert known["order"].count() == 41 and known["order"].filter("slot = 2").first().team == "NATION_3"
    with pytest.raises(ValueError, match="NOWHERE"):
        known.put_order(spark.createDataFrame([(2, 1, "nowhere")], "slot int, round int, team string"))


def test_summary_context_demo(tables, spark, sf_dir):
    board = Board(tables[0], tables[1].as_of)
    rows = board.team_summary().collect()
    assert len(rows) == 25 and any(r.history for r in rows)
    assert all(len(r.players) == 5 and r.explanation.startswith(f"{r.team} enters") and r.next_slot for r in rows)
    demo = {r.model: r for r in board.backtest_demo().collect()}
    assert {m: round(r.log_loss, 6) for m, r in demo.items()} == {"base": 0.802649, "adjusted": 0.661377, "ensemble": 0.749440}
    assert all(r.top1 == r.top3 == 1.0 for r in demo.values())
    assert sorted(map(str, board.draft_context().collect())) == sorted(map(str, QUERIES["team_draft_context"](spark, sf_dir).collect()))
    assert board.health() == {"status": "ok"} and board.team_history().filter("place = 1").count() <= 25


def test_history_is_ordered(spark):
    votes = spark.createDataFrame([("A", 2024, 3, 1, "QB"), ("A", 2025, 1, 1, "OT"), ("A", 2025, 40, 2, "S"), ("A", 2026, 1, 1, "K"), ("B", 2019, 1, 1, "K")], "team string, year int, slot int, round int, position string")
    rows = org.history(votes, spark.createDataFrame([("A",)], "team string"), 2026, 5).orderBy("place").collect()
    assert [(r.year, r.slot) for r in rows] == [(2025, 40), (2025, 1), (2024, 3)]
