"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table: (offset + j * skip) mod
size. Shards take turns; at its turn a shard claims the first slot of its permutation that is
still free. The shares differ by at most one slot, and if a shard goes, few keys of the others
move. The table is broadcast, so a row is placed by one hash and one look-up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def slot_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. slots is a prime and at least the number of shards."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, with at least one and at most that many distinct shards")
    seeds = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(s[:8], "big") % slots for s in seeds]
    skip = [int.from_bytes(s[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for s in seeds]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def assign_shards(docs: DataFrame, id_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All rows and columns of docs, and the column shard (it replaces one of that name).

    Equal keys, so also repeated rows, go to one shard; rows with a null key go where the key ''
    goes. The table has `slots` rows whatever the input's size. An empty table stays empty.
    """
    owners = ",".join(map(str, slot_table(shards, slots)))
    spark = docs.sparkSession
    names = F.element_at(F.array(*map(F.lit, shards)), F.col("owner").cast("int") + 1)
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select(F.col("slot").cast("long").alias("__slot"), names.alias("__shard"))
    placed = docs.join(F.broadcast(table), slot_of(docs[id_col], slots) == table["__slot"], "left")
    shard = table["__shard"].alias("shard")
    kept = [shard if c == "shard" else docs[f"`{c}`"] for c in docs.columns]
    return placed.select(*kept, *([] if "shard" in docs.columns else [shard]))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Writes one folder per shard; a shard's rows are dealt over at most `files` tasks, whatever the ids, by all columns."""
    placed = assign_shards(docs, id_col, shards, slots)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*[f"`{c}`" for c in docs.columns if c != "shard"]), F.lit(files))).write.partitionBy("shard").parquet(path)
