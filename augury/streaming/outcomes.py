"""Outcomes and articles as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.operators.consensus import movement
from augury.operators.stored import Store
from augury.operators.upserts import keep_latest


def read_files(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def unique_articles(articles: DataFrame, when: str = "published", key: str = "content_hash", delay: str = "2 days") -> DataFrame:
    """Each hash once within the watermark. A timestamp without zone counts as UTC."""
    return articles.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, when: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    rows = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, delay)
    return rows.groupBy(F.window(when, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def table_at(spark: SparkSession, path: str, key: list[str], version: str, upto: int | None = None, schema: str | None = None) -> DataFrame | None:
    """The table after batch `upto`, or after the last one: per key the newest batch's row with the highest version.

    None before the first batch, unless a schema is given. Batches whose versions were removed are gone.
    """
    store = Store(spark, path)
    manifest = store.manifest()
    if upto is not None and manifest["batches"].get(BATCHES, -1) > upto:
        older = (m for v in reversed(store.versions()) if (m := store.manifest(v))["batches"].get(BATCHES, -1) <= upto)
        manifest = next(older, {"tables": {}})
    rows = store.read(CHANGES, manifest=manifest)
    if rows is None:
        return spark.createDataFrame([], schema) if schema else None
    return _last(rows, key, version).drop("__batch")


#: A store's table of changes, and the writer whose batches its versions count.
CHANGES, BATCHES = "changes", "stream"


def _last(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    return keep_latest(rows, key, [F.desc("__batch"), F.col(version).desc_nulls_last()])


def keep_outcomes(stream: DataFrame, path: str, checkpoint: str, key: list[str], version: str, then: Callable[[DataFrame, int], None] | None = None, fold_every: int = 20, grace_s: float = 86_400) -> StreamingQuery:
    """Keeps the last row of every key that a stream of changes gives; table_at reads the table.

    A batch adds its own rows only, so its cost follows its size and not the table's; every
    fold_every batches all changes are folded into one folder. Each of them is one version of the
    store at path: a batch or a fold that dies leaves the version before it, readers meet no half
    written rows, and a batch that is run again changes nothing. Versions that were replaced go after
    the grace period. then(table, n) may recompute a board; it is called again with a batch.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path)
        base = store.manifest()
        fresh = keep_latest(batch, key, [F.col(version).desc_nulls_last()]).withColumn("__batch", F.lit(n).cast("long"))
        if len(base["tables"].get(CHANGES, {"parts": []})["parts"]) < fold_every:
            store.commit(append={CHANGES: fresh}, batch=(BATCHES, n), base=base)
        elif store.commit(replace={CHANGES: _last(store.read(CHANGES, manifest=base).unionByName(fresh), key, version)}, batch=(BATCHES, n), base=base):
            store.vacuum(grace_s)
        if then:
            then(table_at(spark, path, key, version, n), n)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def movement_feed(board_of: Callable[[DataFrame], DataFrame], path: str, key: str, value: str, shown: int = 8) -> Callable[[DataFrame, int], None]:
    """A hook for keep_outcomes: keeps the board of the last batch and, with the batch's number, its first `shown` moves since the one before.

    Both are tables of the store at path, board and moves, and change together.
    """

    def then(table: DataFrame, n: int) -> None:
        store = Store(table.sparkSession, path)
        base = store.manifest()
        before, now = store.read("board", manifest=base), board_of(table)
        moves = movement(now.limit(0) if before is None else before, now, key, value).orderBy(key).limit(shown)
        store.commit(replace={"board": now}, append={"moves": moves.withColumn("batch", F.lit(n).cast("long"))}, batch=("feed", n), base=base)

    return then


def running_accuracy(outcomes: DataFrame, listed: DataFrame) -> DataFrame:
    """Of a stream of outcomes (slot, cand): how many, and how often a consensus (slot, cand, rank) has them first or listed.

    An aggregate over the whole stream, for the output mode complete. The list is a table of a few names per slot.
    """
    ranks = F.broadcast(listed.select("slot", "cand", "rank"))
    rows = outcomes.join(ranks, ["slot", "cand"], "left")
    rate = lambda hit: F.avg(F.coalesce(hit, F.lit(False)).cast("double"))
    return rows.groupBy().agg(F.count(F.lit(1)).alias("announced"), rate(F.col("rank") == 1).alias("top1_rate"), rate(F.col("rank") <= 8).alias("top8_rate"))
