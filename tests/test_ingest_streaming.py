"""Record files, upserts and streams."""

from pyspark.sql import functions as F

from augury.operators import upserts
from augury.operators.stored import Store
from augury.sources import records
from augury.streaming import outcomes


def test_csv_with_mark_missing_columns_and_rejects(spark, tmp_path):
    path = tmp_path / "order.csv"
    path.write_text("﻿overall_pick,team_abbreviation\n1,TEN\n,CLE\nx,NYG\n 4 , \n", encoding="utf-8")
    rows = records.read_csv(spark, str(path), records.ORDER)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, None, "TEN"), (None, None, "CLE"), (None, None, "NYG"), (4, None, None)], key=str)
    good, bad = records.split_rejects(rows, ["overall_pick", "team_abbreviation"])
    a = records.audit(good, bad, "overall_pick").first()
    assert (a.min_year, a.max_year, a.inserted, a.failed, a.status) == (1, 1, 1, 3, "partial")


def test_three_state_booleans(spark):
    raw = spark.createDataFrame([(v,) for v in ("1", "True", "no", " ", None)], "traded string").coalesce(1)
    assert [r.traded for r in records.typed(raw, "traded boolean").collect()] == [True, True, False, None, None]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, ver int")
    once = upserts.upsert(old, new, ["k"], "ver")
    want = [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upserts.upsert(once, new, ["k"], "ver").collect())) == want
    assert upserts.unseen(new, old, ["k"]).count() == 1


def test_new_members_are_numbered_in_order(spark):
    names = ["b", "abc", "abd", "ab", "a", "zz", "é", "known", "b", ""]
    dim = spark.createDataFrame([(41, "known")], "id long, name string")
    got = upserts.get_or_create(dim, spark.createDataFrame([(n,) for n in names], "name string"), "name", "id")
    want = sorted({*names} - {"known"}, key=lambda n: n.encode())
    assert {r.name: r.id for r in got.collect()} == {"known": 41} | {n: 42 + k for k, n in enumerate(want)}
    assert upserts.get_or_create(dim.limit(0), dim.select("name"), "name", "id").collect()[0].id == 1
    assert upserts.get_or_create(dim, dim.select("name"), "name", "id").collect() == dim.collect()


def test_names_that_begin_alike_are_dealt_over_ranges(spark):
    names = spark.range(20_000).select(F.concat(F.lit("Player "), F.col("id")).alias("name"))
    dim = spark.createDataFrame([], "id long, name string")
    got = {r.name: r.id for r in upserts.get_or_create(dim, names, "name", "id").collect()}
    assert got == {n: k for k, n in enumerate(sorted(got), 1)} and len(got) == 20_000


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "cycle int, v string").write.partitionBy("cycle").parquet(path)
    upserts.replace_partitions(spark.createDataFrame([(2, "c")], "cycle int, v string"), path, ["cycle"])
    assert sorted((r.cycle, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


SCHEMA = "event_id long, user_id long, event_type string, value double"


def test_stream_of_outcomes_equals_batch(spark, tmp_path):
    """Batches in a known order: the last write of a key wins, whatever its version; folding changes nothing."""
    source = str(tmp_path / "in")
    batches = [[(1, 1, "a", 1.0), (2, 1, "a", 2.0), (3, 2, "a", 3.0)], [(0, 1, "a", 9.0), (5, 3, "b", 5.0)], [(6, 2, "a", 6.0)], [(7, 9, "z", 7.0)], [(8, 3, "b", 8.0)]]
    seen, key = {}, ["user_id", "event_type"]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = outcomes.read_files(spark, source, SCHEMA, 100)
        run = outcomes.keep_outcomes(stream, str(tmp_path / "out"), str(tmp_path / "cp"), key, "event_id", lambda table, n: seen.update({n: sorted(map(tuple, table.collect()))}), fold_every=2)
        run.awaitTermination()
        want = {}
        for earlier in batches[: n + 1]:
            for r in sorted(earlier):
                want[r[1], r[2]] = r
        assert seen[n] == sorted(want.values())
        assert sorted(map(tuple, outcomes.table_at(spark, str(tmp_path / "out"), key, "event_id").collect())) == seen[n]
    assert list(seen) == [0, 1, 2, 3, 4]
    store = Store(spark, str(tmp_path / "out"))
    assert [len(store.manifest(v)["tables"]["changes"]["parts"]) for v in store.versions()] == [1, 2, 1, 2, 1]
    for n, want in seen.items():  # every batch can still be read
        assert sorted(map(tuple, outcomes.table_at(spark, str(tmp_path / "out"), key, "event_id", n).collect())) == want
    assert outcomes.table_at(spark, str(tmp_path / "out"), key, "event_id", -1) is None
    assert outcomes.table_at(spark, str(tmp_path / "none"), key, "event_id") is None and outcomes.table_at(spark, str(tmp_path / "none"), key, "event_id", schema=SCHEMA).isEmpty()


def test_movement_feed_and_running_accuracy(spark, tmp_path):
    source = str(tmp_path / "in")
    feed = outcomes.movement_feed(lambda t: t.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("top")), str(tmp_path / "feed"), "user_id", "top", 2)
    for rows in ([(1, k, "a", 0.0) for k in range(5)], [(2, k, "b", 0.0) for k in (0, 2, 4)] + [(2, 1, "a", 0.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run = outcomes.keep_outcomes(outcomes.read_files(spark, source, SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id", "event_id"], "event_id", feed)
        run.awaitTermination()
    moves = Store(spark, str(tmp_path / "feed")).read("moves")
    assert [tuple(r) for r in moves.orderBy("user_id").collect()] == [(0, "a", "b", 1), (2, "a", "b", 1)]
    listed = spark.createDataFrame([(k, "a", 1) for k in range(3)] + [(3, "a", 2), (0, "b", 2)], "slot long, cand string, rank int")
    stream = outcomes.read_files(spark, source, SCHEMA).select(F.col("user_id").alias("slot"), F.col("event_type").alias("cand"))
    q = outcomes.running_accuracy(stream, listed).writeStream.format("memory").queryName("accuracy").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("accuracy").first()
    assert (r.announced, round(r.top1_rate, 6), round(r.top8_rate, 6)) == (9, round(4 / 9, 6), round(6 / 9, 6))


def test_streaming_dedupe_and_windows(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    source = str(tmp_path / "in")
    rows.unionAll(rows).coalesce(1).write.parquet(source)
    stream = outcomes.read_files(spark, source, "event_id long, ts timestamp_ntz, event_type string")
    unique = outcomes.unique_articles(stream, "ts", "event_id", "60 days")
    counted = outcomes.windowed_counts(rows, "ts", "event_type")
    q = unique.writeStream.format("memory").queryName("unique_events").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_events").count() == rows.count()
    s = outcomes.windowed_counts(outcomes.read_files(spark, source, "event_id long, ts timestamp_ntz, event_type string"), "ts", "event_type")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counts").select("w", "event_type", (F.col("n") / 2).cast("long").alias("n"))
    assert got.exceptAll(counted).isEmpty() and got.count() == counted.count()
