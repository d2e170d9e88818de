"""A board that is kept up to date by a stream of votes, from tallies in a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.operators import consensus, tallies
from augury.operators.stored import Store

#: A board has at most so many slots: that of the longest list of one batch's slots.
MAX_SLOTS = 400
TALLIES, BOARD = "tallies", "board"


def current_tallies(store: Store, slots: list[int] | None = None) -> DataFrame | None:
    """The tallies of some slots, or of all: folders are partitioned by slot, so only those slots' files are read."""
    rows = store.read(TALLIES)
    if rows is None:
        return None
    return tallies.merged(rows.filter(F.col("slot").isin(slots)) if slots is not None else rows)


def current_board(store: Store) -> DataFrame | None:
    """The consensus of every slot as its newest batch gave it."""
    rows = store.read(BOARD)
    if rows is None:
        return None
    newest = F.max("batch").over(Window.partitionBy("slot"))  # a few rows for each slot and batch
    return rows.withColumn("__newest", newest).filter("batch = __newest").drop("__newest", "batch")


def keep_board(stream: DataFrame, path: str, checkpoint: str, as_of: Column, top_n: int = 5, taken: DataFrame | None = None, fold_every: int = 20, grace_s: float = 86_400) -> StreamingQuery:
    """Adds a stream's votes to the tallies of a store and makes the consensus of the slots that they touch anew.

    A batch reads and writes its own slots only, whatever the number of votes so far. as_of, at a
    midnight, and taken (slot, cand) are as of this run; refreshed() makes all slots anew for others. A batch
    that dies or is run again changes nothing twice: tallies and board have their own batch numbers.
    """

    def run(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, path)
        base = store.manifest()
        folds = len(base["tables"].get(TALLIES, {"parts": []})["parts"]) >= fold_every
        fresh, by = tallies.daily(batch), {TALLIES: ["slot"]}
        if folds:
            store.commit(replace={TALLIES: tallies.merged(store.read(TALLIES, manifest=base).unionByName(fresh))}, by=by, batch=(TALLIES, n), base=base)
        else:
            store.commit(append={TALLIES: fresh}, by=by, batch=(TALLIES, n), base=base)
        slots = [r.slot for r in batch.select("slot").distinct().limit(MAX_SLOTS + 1).collect()]
        if len(slots) > MAX_SLOTS:
            raise ValueError(f"votes for more than {MAX_SLOTS} slots")
        touched = consensus_of(current_tallies(store, slots), as_of, top_n, taken).withColumn("batch", F.lit(n).cast("long"))
        base = store.manifest()
        if folds and store.read(BOARD, manifest=base) is not None:
            kept = current_board(store).withColumn("batch", F.lit(-1).cast("long")).filter(~F.col("slot").isin(slots))
            store.commit(replace={BOARD: kept.unionByName(touched)}, batch=(BOARD, n), base=base)
            store.vacuum(grace_s)
        else:
            store.commit(append={BOARD: touched}, batch=(BOARD, n), base=base)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consensus_of(rows: DataFrame, as_of: Column, top_n: int = 5, taken: DataFrame | None = None) -> DataFrame:
    rows = tallies.open_tallies(rows, taken) if taken is not None else rows
    return consensus.of_tally(tallies.at(rows, as_of), top_n)


def refreshed(spark: SparkSession, path: str, as_of: Column, top_n: int = 5, taken: DataFrame | None = None) -> DataFrame | None:
    """The consensus of all slots at another midnight or after other outcomes, from the tallies alone."""
    rows = current_tallies(Store(spark, path))
    return None if rows is None else consensus_of(rows, as_of, top_n, taken)
