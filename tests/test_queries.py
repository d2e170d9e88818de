"""Every registered domain query against its DuckDB SQL on the smallest tables, and the shape of the entry points."""

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry_points
from augury.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir)
    rows = out.collect()
    assert rows
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(out.columns)
        order = [want.columns.index(c) for c in out.columns]
        expected = [[plain(r[k]) for k in order] for r in want.fetchall()]
        assert sorted(map(str, expected)) == sorted(str([plain(v) for v in r]) for r in rows)


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == ["slot", "rank", "cand", "probability", "weighted_probability", "other_probability", "category_count"]


def test_board_awareness_never_adds_rows_and_mass_is_one(spark, sf_dir):
    from pyspark.sql import functions as F

    from augury.operators import consensus
    from augury.plans.tables import Tables

    t = Tables(spark, sf_dir)
    votes = t.votes()
    assert consensus.open_votes(votes, t.outcomes()).count() <= votes.count()
    every = consensus.consensus(votes, t.as_of, 10_000)
    for r in every.groupBy("slot").agg(F.sum("probability").alias("p"), F.max("other_probability").alias("o")).collect():
        assert r.p + r.o == pytest.approx(1.0)


def test_exclusion_is_a_hash_or_merge_join(spark, sf_dir):
    plan = QUERIES["consensus_board_aware"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def scans(spark, sf_dir, name, table):
    """How often the executed plan reads a table; what is planned for reuse counts once."""
    out = QUERIES[name](spark, sf_dir)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(f"{sf_dir}/{table}.parquet" in line and "Scan" in line for line in plan.splitlines())


def test_large_tables_are_read_once_per_role(spark, sf_dir):
    assert scans(spark, sf_dir, "landing_spots", "lineitem") == 1
    assert scans(spark, sf_dir, "live_board", "lineitem") == 1  # the outcomes are rows of the plan
    assert scans(spark, sf_dir, "need_scores", "part") == 1


def test_no_cartesian_products(spark, sf_dir):
    for name in ("candidate_features", "default_candidates", "resolve_teams", "team_alias_contains_join", "ingest_articles"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
