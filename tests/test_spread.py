"""What a task makes, sorts, keeps or is sent stays bounded, whatever the number of files or teams, and results stay the same."""

from pyspark.sql import functions as F

from augury.operators import candidates


def prospects(spark, n):
    return spark.range(0, n, 1, 1).select(
        F.col("id").alias("candidate_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("P"), F.col("id") % 4)).alias("position"),
        (F.col("id") % 97 / 97).alias("prospect"), (F.col("id") % 89 / 89).alias("star"), F.when(F.col("id") % 3 != 0, F.col("id") + 1).alias("consensus_rank"),
    )


NEEDS = [("A", "P0", 0.5), ("A", "P1", 0.9), ("B", "P0", 0.1), ("B", "P0", 0.2), ("C", "none", 0.3), (None, "P2", 0.4), ("D", None, 0.6), ("E", "P3", None)]


def test_candidates_of_one_file_are_dealt_over_tasks(spark):
    """F1 to F5, F8: 60,000 candidates of one partition made 120,000 rows in one task."""
    rows = candidates.features(prospects(spark, 60_000), spark.createDataFrame([("A", "P0", 0.5), ("B", "P1", 0.9)], "team string, position string, need double"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 2 * 1.1 * candidates.TASK_CANDIDATES


def test_features_are_those_of_plain_joins(spark, monkeypatch):
    """Teams without the need, two needs of one position, and keys that are null, as joins have them; dealt over tasks or not."""
    given, needs = prospects(spark, 500), spark.createDataFrame(NEEDS, "team string, position string, need double")
    within = given.groupBy("position").agg(F.min("consensus_rank").alias("best_in_position"))
    plain = given.crossJoin(needs.select("team").distinct().filter("team IS NOT NULL")).withColumn("best", F.lit(2)).join(within, "position", "left").join(needs, ["team", "position"], "left")
    want = sorted(map(str, candidates._featured(plain).collect()))
    for size in (25_000, 100):
        monkeypatch.setattr(candidates, "TASK_CANDIDATES", size)
        assert sorted(map(str, candidates.features(given, needs).collect())) == want
    monkeypatch.setattr(candidates, "HELD_ROWS", 2)
    monkeypatch.setattr(candidates, "held", lambda df: df)
    assert sorted(map(str, candidates.features(given, needs).collect())) == want


def test_scenario_pairs_goes_through_the_candidates_once(spark, sf_dir):
    """both firsts were computed from all candidates."""
    from augury.plans.queries import QUERIES

    out = QUERIES["scenario_pairs"](spark, sf_dir)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Scan parquet" in line and "p_retailprice" in line for line in plan.splitlines()) == 1


def test_backtest_counts_votes_before_it_joins_them(spark):
    """every vote was shuffled twice, by slot and by candidate."""
    import re

    from augury.operators import backtest

    votes = spark.createDataFrame([("s", 1, "a", "T"), ("s", 1, "a", "T"), ("s", 3, "a", None), ("s", 2, "b", "U"), ("r", 9, "c", "T"), ("q", 40, "a", "T"), ("q", 40, "a", "T")], "source string, slot int, cand string, team string")
    outcomes = spark.createDataFrame([(1, "a", "T", 1), (2, "c", "T", 2), (2, "b", None, 3)], "slot int, cand string, team string, id int")
    out = backtest.source_backtest(votes, outcomes)
    columns = ["source", "exact_pick_hits", "player_team_hits", "round1_player_hits", "avg_pick_distance"]
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == [("q", 0, 2, 0, 39.0), ("r", 0, 1, 1, 7.0), ("s", 3, 2, 4, 0.5)]
    assert re.search(r"Aggregate \[source#\d+, slot#\d+, cand#\d+, team#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())


def test_articles_are_shuffled_once_and_labels_resolved_once(spark, tmp_path, monkeypatch):
    """picks were shuffled as a value and as an order, and labels resolved for new and for known articles apart."""
    from augury.functions.teams import teams
    from augury.operators import ingest

    pick = "array<struct<overall_pick:int,round_number:int,original_team:string,current_team:string,traded:boolean,player_name:string,position:string,school:string>>"
    one = [(1, 1, None, "Chicago Bears", False, "A", "qb", None)]
    rows = [("s", f"u{k}", "t", 2020, k, one) for k in range(4)]
    parsed = spark.createDataFrame(rows, f"source_slug string, article_url string, title string, draft_year int, published int, picks {pick}")
    stored = ingest.with_key(parsed.filter("published < 2"))
    old, old_picks = stored.select(*ingest.KEY), ingest.picks_of(stored, teams(spark).limit(0))
    calls, resolve = [], ingest.resolve_teams
    monkeypatch.setattr(ingest, "resolve_teams", lambda *a, **b: (calls.append(1), resolve(*a, **b))[1])
    args = (parsed, old, old_picks, spark.createDataFrame([("s",)], "slug string"), spark.createDataFrame([(2020,)], "year int"), teams(spark))
    articles, picks, _ = ingest.ingest(*args)
    assert articles.count() == 4 and picks.filter("current_team_id IS NOT NULL").count() == 4 and len(calls) == 1
    assert picks.columns == old_picks.columns and "max_by" not in picks._jdf.queryExecution().optimizedPlan().toString()
