"""Tallies against the consensus of the votes themselves: at several days, compacted, merged, streamed."""

import pytest
from pyspark.sql import functions as F

from augury.operators import consensus, tallies
from augury.operators.stored import Store
from augury.plans.tables import Tables
from augury.streaming import outcomes
from augury.streaming import tallies as streamed

DAYS = ["1996-03-01", "1998-08-02", "2000-01-01"]


def close(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=lambda r: r[:3]) for x in (a, b))
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)


def midnight(day):
    return F.lit(day).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def votes(spark, sf_dir):
    rows = Tables(spark, sf_dir).votes()
    # Publications at any time of a day.
    shifted = F.timestamp_add("SECOND", (F.col("article") * 7919 % 86_400).cast("int"), F.col("published").cast("timestamp")).cast("timestamp_ntz")
    return rows.withColumn("published", F.when(F.col("article") % 3 == 0, F.col("published")).otherwise(shifted)).cache()


@pytest.mark.parametrize("day", DAYS)
def test_tallies_give_the_consensus_of_any_day(votes, day):
    close(consensus.of_tally(tallies.at(tallies.daily(votes), midnight(day)), 50), consensus.consensus(votes, midnight(day), 50))


@pytest.mark.parametrize("day", DAYS[1:])
def test_compacted_and_merged_tallies(spark, votes, day):
    upto = spark.range(1).select(tallies.day_of(midnight(DAYS[1]))).first()[0]
    parts = [tallies.daily(votes.filter(F.col("article") % 3 == k)) for k in range(3)]
    state = tallies.compacted(tallies.compacted(parts[0], upto - 700).unionByName(parts[1]).unionByName(parts[2]), upto)
    assert state.count() < tallies.daily(votes).count()
    close(consensus.of_tally(tallies.at(state, midnight(day)), 50), consensus.consensus(votes, midnight(day), 50))


def test_tallies_after_outcomes(spark, sf_dir, votes):
    taken = Tables(spark, sf_dir).outcomes()
    close(streamed.consensus_of(tallies.daily(votes), midnight(DAYS[2]), 9, taken), consensus.consensus(consensus.open_votes(votes, taken), midnight(DAYS[2]), 9))


def test_a_streamed_board_equals_the_batch(spark, votes, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    columns = ["slot", "cand", "tau", "weight", "published"]
    rows = votes.select(*columns)
    batches = [rows.filter("slot IN (1, 2)"), rows.filter("slot = 3"), rows.filter("slot IN (3, 4) AND weight > 1"), rows.filter("slot > 4"), rows.filter("slot = 1").limit(40)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    so_far, as_of = None, midnight(DAYS[2])
    for n, part in enumerate(batches):
        part.coalesce(1).write.mode("append").parquet(source)
        part = spark.createDataFrame(part.collect(), rows.schema)
        so_far = part if so_far is None else so_far.unionByName(part)

        def start():
            return streamed.keep_board(outcomes.read_files(spark, source, schema, 100), path, str(tmp_path / "cp"), as_of, 7, fold_every=3, grace_s=0)

        if n in (1, 3):  # the batch dies between its two commits, and is run again
            commit = Store.commit

            def dies(self, *a, batch=None, **k):
                return 1 / 0 if batch[0] == streamed.BOARD else commit(self, *a, batch=batch, **k)

            with monkeypatch.context() as m:
                m.setattr(Store, "commit", dies)
                with pytest.raises(Exception, match="division"):
                    start().awaitTermination()
        start().awaitTermination()
        close(streamed.current_board(Store(spark, path)), consensus.consensus(so_far, as_of, 7))
    close(streamed.refreshed(spark, path, midnight(DAYS[1]), 7), consensus.consensus(so_far, midnight(DAYS[1]), 7))
    plan = streamed.current_tallies(Store(spark, path), [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan
