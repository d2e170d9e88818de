import pytest

from augury.api import Board
from augury.plans.queries import QUERIES
from augury.plans.tables import Tables


@pytest.fixture(scope="module")
def board(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Board({"votes": t.votes(), "outcomes": t.outcomes(), "order": t.order(), "roster": t.roster(), "needs": t.needs(), "candidates": t.candidates().filter("candidate_id < 60"), "org": t.org()}, t.as_of)


def test_answers(board, spark, sf_dir):
    one = board.pick_consensus(3, 2, board_aware=True)
    assert [r.slot for r in one.collect()] == [3, 3] and "low_confidence" in one.columns
    assert board.live_board(40).count() == 40
    assert sorted(map(tuple, board.next_slots().collect())) == sorted(map(tuple, QUERIES["next_open_slot"](spark, sf_dir).collect()))
    assert board.source_backtest().count() == 5 and board.landing_spots("Brand#2").count() == 0
    assert board.landing_spots(context_slot=2, top_n=1).count() == 25
    assert {r["count"] for r in board.team_needs(3).groupBy("team").count().collect()} == {3}
    assert board.player_probabilities(40).filter("team = 'NATION_1'").count() == 48
    assert board.compare_with_consensus(2).count() == board.org_profile().count() == board.team_summary().count() == 25
    for r in board.org_position_vectors().groupBy("team").sum("base", "adjusted", "delta").collect():
        assert tuple(r)[1:] == pytest.approx((1.0, 1.0, 0.0))
    assert board.team_history().count() > 0


def test_arguments(board):
    for call in (lambda: board.pick_consensus(0), lambda: board.pick_consensus(1, 51), lambda: board.live_board(401), lambda: board.landing_spots("x", context_slot=500), lambda: board.team_history(13)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        board["nothing"]


def reference_list(prospects, taken, slot, limit=None, scan=200):
    """The list of one slot, candidate by candidate."""
    out = []
    for place, p in enumerate(sorted(prospects, key=lambda p: (p.consensus_rank is None, p.consensus_rank or 0, p.candidate_id))[:scan], 1):
        if any(name == p.name and at < slot for at, name in taken):
            continue
        out.append((p.consensus_rank or p.big_board_rank or slot + place, place, p.candidate_id))
        if len(out) >= (limit or (48 if slot >= 33 else 24)):
            break
    return [c for _, _, c in sorted(out)] if out else reference_list(prospects, [], slot, limit, scan)


@pytest.fixture(scope="module")
def drafting(spark, sf_dir, board):
    t = Tables(spark, sf_dir)
    rows, taken = t.board_prospects().collect(), [(r.slot, r["name"]) for r in t.drafted().collect()]
    outcomes = t.drafted().selectExpr("slot", "name AS cand", "CAST(NULL AS STRING) AS team", "1 AS round", "slot AS id")
    return Board(board._tables | {"prospects": t.board_prospects(), "outcomes": outcomes}, t.as_of), rows, taken


def test_lists_of_all_slots_are_those_of_each_slot(drafting):
    board, rows, taken = drafting
    for aware in (True, False):
        got = {}
        for r in board.candidate_lists(board_aware=aware).collect():
            got.setdefault(r.slot, []).append((r.best_available_rank, r.candidate_id))
        assert sorted(got) == list(range(1, 41))
        for slot, listed in got.items():
            want = reference_list(rows, taken if aware else [], slot)
            assert [c for _, c in sorted(listed)] == want and [k for k, _ in sorted(listed)] == list(range(1, len(want) + 1))
    few = sorted((r.best_available_rank, r.candidate_id) for r in board.candidate_lists(9, True, limit=12).collect())
    assert [c for _, c in few] == reference_list(rows, taken, 9, 12)


def test_a_board_without_anybody_left_is_an_empty_board(spark, drafting):
    board, rows, _ = drafting
    everybody = spark.createDataFrame([(1, r["name"].upper()) for r in rows], "slot int, cand string")
    gone = Board(board._tables | {"outcomes": everybody}, board.as_of)
    listed = sorted((r.best_available_rank, r.candidate_id) for r in gone.candidate_lists(5, True).collect())
    assert [c for _, c in listed] == reference_list(rows, [], 5)
    assert gone.candidate_lists(1, True).count() == 24  # taken at slot 1 counts from slot 2 on


def test_players_of_a_slot_by_rank_and_given(spark, drafting):
    board, rows, taken = drafting
    for aware in (True, False):
        want = reference_list(rows, taken if aware else [], 7)
        got = board.player_probabilities(7, aware).filter("team = 'NATION_3'").orderBy("rank").collect()
        assert sorted(r.candidate_id for r in got) == sorted(want) and [r.probability for r in got] == sorted((r.probability for r in got), reverse=True)
        ranks = {r.candidate_id: r.consensus_rank for r in got}
        assert all(r.gap_best == ranks[r.candidate_id] - min(ranks.values()) for r in got)
    taken_now = next(name for at, name in taken if at < 7)
    given = spark.createDataFrame([("New Face", "LARGE", 0.9, 0.8, 3), (taken_now, "SMALL", 0.5, 0.5, 1), ("Other", "SMALL", 0.1, 0.1, None)], "name string, position string, prospect double, star double, consensus_rank int")
    names = lambda aware: [r["name"] for r in board.player_probabilities(7, aware, given).filter("team = 'NATION_3'").orderBy("best_available_rank").collect()]
    assert names(False) == [taken_now, "New Face", "Other"] and names(True) == ["New Face", "Other"]
    only = given.filter(given.name == taken_now)
    assert len([r for r in board.player_probabilities(7, True, only).filter("team = 'NATION_3'").collect()]) == 24


def test_comparison_and_summary_know_the_board(spark, drafting):
    board, rows, taken = drafting
    aware = {r.team: r for r in board.compare_with_consensus(5, True).collect()}
    for r in aware.values():
        assert r.agreement == len(set(r.model) & set(r.consensus)) and r.only_a == len(set(r.model) - set(r.consensus))
        assert (r.need_component, r.talent_component, r.context_component) == (0.0, 0.0, 0.0) and 0 <= r.top_override <= 1
        assert r.top_player.lower() == r.model[0] and not {n for at, n in taken if at < 5} & set(r.model)
    nobody = board.compare_with_consensus(40).collect()  # no votes for that slot
    assert len(nobody) == 25 and all(r.consensus == [] and r.disagreement == 1.0 for r in nobody)
    for r in board.team_summary(6, True).collect():
        gone = {n for at, n in taken if at < 6}
        assert len(r.players) == len(r.model_players) == 5 and not gone & {p["name"] for p in r.players + r.model_players}
        assert [p["rank"] for p in r.consensus_players] == sorted(p["rank"] for p in r.consensus_players)
    whole = {r.candidate_id for r in board.org_player_vectors(6, True).filter("team = 'NATION_3'").collect()}
    assert whole == set(reference_list(rows, taken, 6, 12))
    first = sorted(rows, key=lambda p: (p.consensus_rank is None, p.consensus_rank or 0, p.candidate_id))[:12]
    assert {r["name"] for r in board.org_player_vectors(6).filter("team = 'NATION_3'").collect()} == {p["name"] for p in first}


def test_features_of_a_slot_are_replaced_as_a_whole(spark, drafting, tmp_path):
    from augury.operators.stored import Store

    board, rows, taken = drafting
    store = Store(spark, str(tmp_path))
    board.keep_features(store, 2025, 7)
    board.keep_features(store, 2026, 7)
    board.keep_features(store, 2026, 8, True)
    now = board.keep_features(store, 2026, 7, True).filter("team = 'NATION_3'").collect()
    by = {}
    for r in now:
        by.setdefault(r.slot, []).append(r.candidate_id)
    assert {k: sorted(v) for k, v in by.items()} == {7: sorted(reference_list(rows, taken, 7)), 8: sorted(reference_list(rows, taken, 8))}
    before = store.read("candidate_features").filter("year = 2025 AND team = 'NATION_3'").collect()
    assert sorted(r.candidate_id for r in before) == sorted(reference_list(rows, [], 7)) and all(r.available and r.round == 1 for r in now)
    contexts = {r.slot: r for r in board.pick_contexts(True).collect()}
    assert sorted(contexts) == list(range(1, 41)) and all(0 < r.board_scarcity_score <= 1 and r.top_need_position for r in contexts.values())
