"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (say domain, language, source) hold tokens. A budget is passed down: each
node shares its part among its children by their weights. A child that cannot use its share, as
its subtree has too few tokens even after max_epochs epochs, gives the rest to its siblings, by
their weights; only what they cannot take goes to the parent's siblings, and so on.

A leaf's budget is a number of whole epochs and a rest. The rest is a token-prefix of the leaf in
the order of a seeded hash, another one for each epoch. The prefix is found without sorting a
leaf: tokens are summed over 256 ranges of the hash, the sums give the one range in which the
prefix ends, which is cut into 256 again, and so on for DEPTH times; only the rows of the last
range are put in order, one in 16 million of the leaf. Rows before and after it are decided where
they are, so texts are not shuffled, however much of the input one leaf holds.

Tokens are those of the tokenizer, as packing counts them, less the end id. What a leaf cannot use
of its budget, as its next document is longer than what is left, is not passed on: it is
less than one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import broadcast_if_small, scratch_table
from augury.llm.token_counts import measured

SEED = 7
#: Bits of the hash that one cut goes by, and the number of cuts.
HASH_BITS, DEPTH = 8, 3
#: Leaves up to here are budgeted on the driver; more by the same rule in windows.
MAX_LEAVES = 200_000
Path = tuple[str, ...]


def water_fill(amount: int, weights: list[float], room: list[int]) -> list[int]:
    """Whole shares of amount by weight, none above its room; what one cannot take the others share by weight.

    Children in order of room per weight are full up to the first whose share has room left.
    """
    w, r = np.asarray(weights, float), np.asarray(room, np.int64)
    out = np.zeros(len(w), np.int64)
    active = np.flatnonzero((w > 0) & (r > 0))
    left = min(amount, int(r[active].sum()))
    order = active[np.argsort(r[active] / w[active], kind="stable")]
    taken, passed = np.cumsum(r[order]) - r[order], np.cumsum(w[order]) - w[order]
    fits = r[order] * (w[order].sum() - passed) <= (left - taken) * w[order]
    cut = int(np.argmin(fits)) if not fits.all() else len(order)
    out[order[:cut]] = r[order[:cut]]
    rest = np.sort(order[cut:])
    if len(rest):
        left -= int(out.sum())
        exact = left * w[rest] / w[rest].sum()
        out[rest] = np.minimum(r[rest], exact.astype(np.int64))
        by_fraction = rest[np.argsort(np.floor(exact) - exact, kind="stable")]
        more = by_fraction[out[by_fraction] < r[by_fraction]][: max(0, left - int(out[rest].sum()))]
        out[more] += 1
    return out.tolist()


def budgets(tokens: dict[Path, int], weights: dict[Path, float], total: int, max_epochs: int = 1) -> dict[Path, int]:
    """The tokens that each leaf gives. A node without a weight of its own has weight 1."""
    children: dict[Path, list[Path]] = {}
    room: dict[Path, int] = {}
    for leaf in sorted(tokens):
        for depth in range(len(leaf)):
            kids = children.setdefault(leaf[:depth], [])
            if not kids or kids[-1] != leaf[: depth + 1]:
                kids.append(leaf[: depth + 1])
        room[leaf] = tokens[leaf] * max_epochs
    for node in sorted(children, key=len, reverse=True):
        room[node] = sum(room[c] for c in children[node] if weights.get(c, 1.0) > 0)
    given: dict[Path, int] = {(): total}
    for node in sorted(children, key=len):
        kids = children[node]
        shares = water_fill(given[node], [weights.get(c, 1.0) for c in kids], [room[c] for c in kids])
        given.update(zip(kids, shares, strict=True))
    return {leaf: given[leaf] for leaf in tokens}


def _shared(rows: DataFrame, path: list[str]) -> DataFrame:
    """water_fill of each node's children (path, room, w, parent: the node's amount) by running sums: path, given."""
    node, active = path[:-1], (F.col("w") > 0) & (F.col("room") > 0)
    all_of = Window.partitionBy(*node)
    before = all_of.orderBy(F.try_divide("room", "w"), path[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = all_of.orderBy(F.try_divide("room", "w"), path[-1]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(active).withColumn("left", F.least(F.col("parent"), F.sum("room").over(all_of)))
    fits = F.col("room") * (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0.0))) <= (F.col("left") - F.coalesce(F.sum("room").over(before), F.lit(0))) * F.col("w")
    rows = rows.withColumn("fits", fits).withColumn("full", F.min("fits").over(upto))
    part = lambda c: F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col(c))).over(all_of)
    rows = rows.withColumns({"left": F.col("left") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(all_of), F.lit(0))}).withColumn("exact", F.coalesce(F.try_divide(F.col("left") * F.col("w"), part("w")), F.lit(0.0)))
    rows = rows.withColumn("given", F.when(F.col("full"), F.col("room")).otherwise(F.least(F.col("room"), F.floor("exact"))))
    rows = rows.withColumn("rest", F.col("left") - part("given"))
    may = ~F.col("full") & (F.col("given") < F.col("room"))
    place = F.row_number().over(all_of.orderBy(F.when(may, 0).otherwise(1), F.floor("exact") - F.col("exact"), path[-1]))
    return rows.select(*path, (F.col("given") + F.when(may & (place <= F.col("rest")), 1).otherwise(0)).cast("long").alias("given"))


def budget_table(leaves: DataFrame, names: list[str], weights: dict[Path, float], total: int, max_epochs: int = 1) -> DataFrame:
    """What budgets gives, for any number of leaves (names, n): names, n, given."""
    spark, depth = leaves.sparkSession, len(names)
    room = leaves.select(*names, "n", (F.col("n") * max_epochs).cast("long").alias("room"))

    def weighted(df: DataFrame, k: int) -> DataFrame:
        listed = [(*path, float(w)) for path, w in weights.items() if len(path) == k]
        table = spark.createDataFrame(listed, ", ".join([*(f"{n} string" for n in names[:k]), "w double"]))
        return df.join(F.broadcast(table), names[:k], "left").fillna(1.0, ["w"])

    levels = [weighted(room.select(*names, "room"), depth)]
    for k in range(depth - 1, 0, -1):
        below = levels[0].withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(0))
        levels.insert(0, weighted(below.groupBy(*names[:k]).agg(F.sum("room").alias("room")), k))

    given = spark.createDataFrame([(int(total),)], "given long")
    for k, level in enumerate(levels, 1):
        above = given.withColumnRenamed("given", "parent")
        rows = level.join(above, names[: k - 1]) if k > 1 else level.join(F.broadcast(above), how="cross")  # one row
        given = scratch_table(_shared(rows, names[:k]), "budget")
    return given.join(leaves.select(*names, "n"), names)


def mix(
    docs: DataFrame,
    levels: dict[str, str],
    weights: dict[Path, float],
    share: float | None = None,
    total: int | None = None,
    max_epochs: int = 1,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    seed: int = SEED,
    text_col: str = "text",
    tokenizer: str | None = None,
    epoch_col: str | None = "epoch",
) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, once for each epoch that takes them.

    levels names the tree's levels from the root and gives each one's SQL expression; a null
    value counts as ''. The budget is total, or share of all tokens. tokens measures a row; by default
    it is the number of ids of its text, 0 for a null one. The epoch, from 0, is in a new column epoch_col,
    with underscores behind its name if docs has a column of that name; None leaves it out.
    Rows of one leaf with one id, repeated ones too, are taken or left together, and rows whose
    hash is equal go by their id. A leaf without tokens gives nothing, and so does a node of weight 0.
    An empty table gives no rows.
    """
    if (share is None) == (total is None):
        raise ValueError("give either share or total")
    own = docs.columns
    names = [f"__level{k}" for k in range(len(levels))]
    path = [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)]
    if tokens is not None:
        sized = docs.select(F.col(id_col).alias("__id"), *path, F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long").alias("__tokens"))
    else:
        sized = measured(docs.select(F.col(id_col).alias("__id"), *path, F.col(text_col).alias("__text")), "__text", "__tokens", tokenizer)
    sized = scratch_table(sized, "sized")
    leaves = scratch_table(sized.groupBy(*names).agg(F.sum("__tokens").alias("n")), "leaves")
    amount = int(share * (leaves.agg(F.sum("n")).first()[0] or 0)) if total is None else total
    few = leaves.limit(MAX_LEAVES + 1).collect()
    if len(few) <= MAX_LEAVES:
        held = {tuple(r[n] for n in names): int(r["n"]) for r in few}
        plan = budgets(held, weights, amount, max_epochs)
        rows = [(*leaf, plan[leaf] // n, plan[leaf] % n) for leaf, n in held.items() if n and plan[leaf]]
        schema = ", ".join([*(f"{n} string" for n in names), "__epochs long", "__rest long"])
        budget = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))  # one row per leaf, at most MAX_LEAVES
    else:
        plan = budget_table(leaves, names, weights, amount, max_epochs).filter("n > 0 AND given > 0")
        budget = scratch_table(plan.select(*names, F.expr("given div n").alias("__epochs"), (F.col("given") % F.col("n")).alias("__rest")), "budget")

    order = F.xxhash64(F.lit(seed), F.col("__epochs"), F.col("__id"))
    rated = sized.join(budget, names).filter("__rest > 0").withColumn("__order", order)
    of_leaf = Window.partitionBy(*names)
    cut = None
    for depth in range(1, DEPTH + 1):
        at = 64 - depth * HASH_BITS
        scope = rated.withColumn("__start", F.lit(0).cast("long"))
        if cut is not None:  # only the rows of the range in which the prefix ends
            within = F.shiftrightunsigned("__order", at + HASH_BITS) == F.col("__cut")
            scope = rated.join(broadcast_if_small(cut.drop("__start")), names).filter(within).withColumnRenamed("__before", "__start").drop("__cut")
        sums = scope.groupBy(*names, "__rest", "__start", F.shiftrightunsigned("__order", at).alias("__range")).agg(F.sum("__tokens").alias("n"))
        before = F.col("__start") + F.coalesce(F.sum("n").over(of_leaf.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("__before", before).filter("__before <= __rest AND __rest < __before + n")
        cut = scratch_table(ends.select(*names, F.col("__range").alias("__cut"), "__before", "__start"), "cut")
    cut = cut.drop("__start")
    shift = 64 - DEPTH * HASH_BITS
    # The range in which the prefix ends, in order.
    edge = rated.join(broadcast_if_small(cut), names).filter(F.shiftrightunsigned("__order", shift) == F.col("__cut"))
    edge = edge.groupBy(*names, "__id", "__order", "__rest", "__before").agg(F.sum("__tokens").alias("n"))
    upto = F.sum("n").over(of_leaf.orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, 0))
    taken = scratch_table(edge.withColumn("__upto", upto + F.col("__before")).filter("__upto <= __rest").select(*names, F.col("__id").alias("__edge")), "edge")

    # The user's columns go by number here, so that none of them can have a name of ours.
    numbered = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)]
    rated = docs.select(*numbered, *path, F.col(id_col).alias("__id")).join(budget, names).withColumn("__order", order)
    rated = rated.withColumn("__range", F.shiftrightunsigned("__order", shift)).join(broadcast_if_small(cut.drop("__before")), names, "left")
    found = broadcast_if_small(taken.withColumnsRenamed({n: f"{n}e" for n in names}).withColumn("__taken", F.lit(True)))
    same = rated["__id"].eqNullSafe(found["__edge"]) & (rated["__range"] == rated["__cut"])
    for n in names:
        same = same & (rated[n] == found[f"{n}e"])
    rated = rated.join(found, same, "left")
    last = F.when((F.col("__range") < F.col("__cut")) | F.col("__taken"), 1).otherwise(0)
    times = rated.withColumn("__times", F.col("__epochs") + last).filter("__times > 0")
    while epoch_col in own:
        epoch_col += "_"
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))
    out = times.select(*[f"c{k}" for k in range(len(own))], each.alias("epoch"))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], *([F.col("epoch").alias(epoch_col)] if epoch_col else []))
