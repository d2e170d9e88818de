"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's frequent-items aggregate) names every digest that
may hold more than `support` of all rows, at most 1 / support of them. Their exact winners are
counted in a second pass, broadcast, and decide their rows without a shuffle; only the other
digests, none of which is frequent, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import broadcast_if_small, fold_ascii, scratch_table, text_or_empty

SUPPORT = 0.001


def text_digest(text: str):
    """sha256, as lowercase hex, of the text after lower-casing A-Z; a null text counts as empty."""
    return F.sha2(fold_ascii(text_or_empty(text)), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; a
    null id is smaller than any other. Of repeated rows with that id exactly one is kept. Null and
    empty texts form one group. An empty table gives no rows. Other columns are not read.
    """
    digests = scratch_table(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    best = [F.max(F.struct("doc_id", "row")), F.count(F.lit(1))]
    frequent = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    # At most 1 / support rows by construction of the summary, whatever the size of the input.
    winners = scratch_table(
        digests.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(best[0].alias("best"), best[1].alias("group_size")).filter("group_size > 1"), "winners"
    )
    tagged = digests.join(F.broadcast(winners), "text_sha256", "left")
    heavy = tagged.filter("group_size IS NOT NULL")
    light = digests.join(F.broadcast(winners), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")  # no group here is frequent
    light = light.withColumns({"best": best[0].over(group), "group_size": best[1].over(group)})
    return heavy.unionByName(light).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The input's rows and columns without those that exact_duplicates drops.

    The dropped ids are broadcast if counting shows that they are few; else both sides are shuffled.
    """
    found = exact_duplicates(docs, id_col, text_col, support)
    lost = scratch_table(
        found.filter("NOT kept").groupBy("doc_id", "text_sha256").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("again")), "lost"
    )
    # The user's columns go by number, so that none of them can have a name of ours.
    own = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(own, docs.columns, strict=True)], F.col(id_col).alias("id"), text_digest(text_col).alias("digest"))
    same = lambda other: rows["id"].eqNullSafe(other["doc_id"]) & (rows["digest"] == other["text_sha256"])
    out = rows.join(broadcast_if_small(lost_ids := lost.filter("NOT again")), same(lost_ids), "left_anti")
    again = lost.filter("again")
    if not again.isEmpty():  # rows repeated under the winner's own id: one of them stays
        once = rows.join(broadcast_if_small(again), same(again), "left_semi").dropDuplicates(["id", "digest"])
        out = out.join(broadcast_if_small(again), same(again), "left_anti").unionByName(once)
    return out.select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True)])
