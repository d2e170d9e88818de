"""Bucketed tables: no exchanges below joins and groups on their key, the same rows, one step from a table to the next."""

import re

import pytest
from pyspark.sql import functions as F

from augury.api import Board
from augury.operators import consensus
from augury.plans.tables import Tables
from augury.sources.catalog import Catalog, session


@pytest.fixture
def catalog(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes at which nothing is broadcast
    made = Catalog(spark, "star_test", str(tmp_path / "star"), buckets=4)
    yield made
    made.drop()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not (tmp_path / "star").exists()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_articles_and_their_picks_join_without_an_exchange(spark, sf_dir, catalog):
    t = Tables(spark, sf_dir)
    picks, articles = catalog.put("picks", t.lineitem, "l_orderkey"), catalog.put("articles", t.orders, "o_orderkey")
    joined = picks.join(articles, F.col("l_orderkey") == F.col("o_orderkey"))
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and re.search(r"SelectedBucketsCount: 4 out of 4", plan)
    once = joined.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan_of(once)
    assert rows(once) == rows(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")))


def test_votes_meet_outcomes_without_an_exchange(spark, sf_dir, catalog):
    t = Tables(spark, sf_dir)
    votes, taken = t.votes(), t.outcomes()
    kept, outcomes = catalog.put("votes", votes, "cand"), catalog.put("outcomes", taken, "cand")
    left = consensus.open_votes(kept, outcomes)
    assert "LeftAnti" in plan_of(left) and "Exchange" not in plan_of(left)
    assert "Exchange" in plan_of(consensus.open_votes(votes, taken))
    six = lambda df: df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    board = Board(catalog.tables() | {"order": t.order()}, t.as_of)
    assert rows(six(consensus.consensus(left, t.as_of))) == rows(six(consensus.consensus(consensus.open_votes(votes, taken), t.as_of)))
    assert rows(six(board.live_board(40))) == rows(six(consensus.live_board(votes, taken, t.order(), t.as_of, 40)))


def test_a_name_switches_to_the_table_that_was_put_last(spark, tmp_path, catalog):
    frame = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    catalog.put("t", frame(1, 2), "k")
    catalog.put("u", frame(5), "k")


    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        catalog.put("t", frame(0).select((F.lit(1) / F.col("k")).cast("long").alias("k")), "k")
    assert rows(catalog.get("t")) == rows(frame(1, 2))
    catalog.put("t", frame(3), "k")
    assert rows(catalog.get("t")) == rows(frame(3)) and catalog.names() == ["t", "u"]
    assert len(list((tmp_path / "star").glob("t__*"))) == 1
    assert session().sparkContext is spark.sparkContext
