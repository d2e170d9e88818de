"""Near copies at a similarity of 0.8 of their sets of 5-word shingles, by tiled SimHash comparison.

Fingerprints alone can't do this: at a similarity of 0.8 two of 64 bits differ by 9.7 on average, with a
deviation of 2.9, and so do many unrelated pairs once there are millions of texts; and no cells
of equal bits bring such pairs together. So the tiles are filled by other keys, and what the
comparison leaves is checked exactly.

Cells. A text's set holds 32 bits of the XXH64 of each distinct shingle. BANDS times ROWS minimum
hashes of it are made, and the ROWS of a band give a cell; two texts at similarity s share one with a
probability of 1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8. Only texts of one cell are compared.

Tiles. Inside a cell the fingerprints are sorted by population count and cut into tiles; tile pairs
whose counts differ beyond RADIUS are skipped, all others are compared with exclusive-or and bit
counts. Pairs within RADIUS, which a pair at 0.8 misses with a probability of about 10^-6, are
checked on the sets, so that no pair below the similarity is linked.

Every text is first compared with the smallest of each of its cells, which joins large groups with
a number of pairs that is linear in their size. Cells that still hold texts of several groups then
go to one task each, with their sets, and give the edges of a spanning forest; a cell that
is too large for that is split, one task for each pair of its parts. No pair of a cell is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm import simhash
from augury.llm.common import batched_texts, broadcast_if_small, release_memory, scratch_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
RADIUS = 24
TILE = 512
#: Bytes of sets of one cell that one task holds, and texts that it compares with one another.
CELL_BYTES = 32 << 20
CELL_ROWS = 2048
#: Comparisons with one text, the smallest of many cells, that one task makes.
HOT_PAIRS = 20_000
BLOCK = 1024
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of one text; of the whole text if it has no more words."""
    import xxhash

    words = simhash._WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(simhash._FOLD))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= size:
        spans = [(0, len(line))]
    else:
        spans = zip([0, *ends[: len(words) - size].tolist()], (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], simhash.SEED) for a, b in spans], np.uint64))


def cells(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit cell for each band, of 32-bit hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(np.uint64)
        least = np.minimum(least, ((part[None, :] * _TIMES[:, None] + _PLUS[:, None]) >> np.uint64(20)).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a digest of the set), bits (its SimHash), cells and set for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            wide = [shingles(t) for t in batch.column(1).to_pylist()]
            sets = [np.unique(w.astype(np.uint32)) for w in wide]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
            bits = np.array([simhash.majority(w) for w in wide], np.uint64).view(np.int64)
            made = pa.array([cells(s) for s in sets], pa.list_(pa.int64())), pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(bits, pa.int64()), *made], ["doc_id", "fp", "bits", "cells", "set"])
            del wide, sets, made
            release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched_texts(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, bits long, cells array<long>, set array<int>")


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least that similar; an a with very many pairs is dealt over several tasks."""
    hot = scratch_table(pairs.groupBy("a").count().filter(F.col("count") > HOT_PAIRS).select("a", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("salts")), "hot")
    dealt, first = pairs.withColumn("salt", F.lit(0)), sets.select(F.col("fp").alias("a"), F.col("set").alias("x"), F.lit(0).alias("salt"))
    if not hot.isEmpty():
        few = broadcast_if_small(hot)
        dealt = pairs.join(few, "a", "left").select("a", "b", F.coalesce(F.pmod(F.hash("b"), F.col("salts")), F.lit(0)).alias("salt"))
        first = first.drop("salt").join(few, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = dealt.join(first, ["a", "salt"]).join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common)


def _forest(fps: list[int], bits: np.ndarray, groups: list[int], sets: list[np.ndarray], similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect whatever of one cell is alike and not of one group yet."""
    counts = np.bitwise_count(bits).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    bits, counts = bits[order], counts[order]
    number: dict[int, int] = {}
    root = [number.setdefault(g, k) for k, g in enumerate(groups[k] for k in order.tolist())]
    left, right = [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tiles = [(a, min(a + TILE, len(bits))) for a in range(0, len(bits), TILE)]
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if counts[c] - counts[b - 1] > radius:  # sorted: no later tile can be nearer
                break
            near = np.bitwise_count(bits[a:b, None] ^ bits[None, c:d]) <= radius
            for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                x, y = x + a, y + c
                if x < y and (p := find(x)) != (q := find(y)) and _alike(sets[order[x]], sets[order[y]], similarity):
                    root[max(p, q)] = min(p, q)
                    left.append(fps[order[x]])
                    right.append(fps[order[y]])
    return left, right


def _compare(batches: Iterator[pa.RecordBatch], similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, bits, root, set) sorted by cell in, edges out; a cell may run over several batches."""
    cell, held = None, []

    def close() -> pa.RecordBatch:
        seen, rows = set(), []
        for row in held:
            if row[0] not in seen:
                seen.add(row[0])
                rows.append(row)
        held.clear()
        fps, bits, groups, sets = zip(*rows, strict=True)
        edges = _forest(fps, np.array(bits, np.int64).view(np.uint64), list(groups), list(sets), similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in edges], ["a", "b"])

    for batch in batches:
        lists = batch.column(4)
        flat, ends = lists.flatten().to_numpy().view(np.uint32), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).tolist()
        for k, (now, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if now != cell and held:
                yield close()
            cell = now
            held.append((*row, flat[ends[k] : ends[k + 1]].copy()))
    if held:
        yield close()
    release_memory()


def links(made: DataFrame, similarity: float = SIMILARITY, cell_bytes: int = CELL_BYTES, cell_rows: int = CELL_ROWS, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between values of fp, given doc_id, fp, bits, cells and set as a table."""
    dealt = made.select("fp", "bits", "cells").dropDuplicates(["fp"]).select("fp", "bits", F.explode("cells").alias("cell"))
    firsts = dealt.groupBy("cell").agg(F.min(F.struct("fp", "bits")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell", "first", "n")
    # A cell of very many texts is not dealt to one task: its first is broadcast.
    firsts = scratch_table(firsts, "firsts")
    shared = scratch_table(simhash.split_join(dealt, firsts, "cell", "n").select("cell", "fp", "bits", F.col("first.fp").alias("a"), F.col("first.bits").alias("a_bits")), "cells")
    within = F.bit_count(F.col("bits").bitwiseXOR(F.col("a_bits"))) <= radius
    pairs = scratch_table(shared.filter("a <> fp").filter(within).select("a", F.col("fp").alias("b")).distinct(), "pairs")
    ends = broadcast_if_small(scratch_table(shared.select("fp").distinct(), "ends"))
    sets = scratch_table(made.select("fp", "set").join(ends, "fp", "left_semi").groupBy("fp").agg(F.any_value("set").alias("set")), "sets")
    near = scratch_table(_near(pairs, sets, similarity), "near")
    roots = simhash.components(near)
    rooted = shared.join(roots, shared["fp"] == roots["node"], "left").select("cell", "fp", "bits", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("cell")
    mixed = broadcast_if_small(scratch_table(mixed, "mixed"))
    # Of a group's members with one set of cells the same edges come: a cell is compared once for all cells with its texts.
    rest = scratch_table(rooted.join(mixed, "cell", "left_semi").join(sets.select("fp", F.size("set").alias("n")), "fp"), "rest")
    held = rest.groupBy("cell").agg(F.sum("n").alias("size"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("of"), F.count(F.lit(1)).alias("rows"))
    once = held.groupBy("of", "rows", "size").agg(F.min("cell").alias("cell")).select("cell", "rows", "size")
    once = once.select("cell", F.ceil(F.greatest(F.col("size") * 4 / cell_bytes, F.col("rows") / cell_rows)).cast("int").alias("parts"))
    rest = rest.join(broadcast_if_small(scratch_table(once, "once")), "cell").select("cell", "fp", "bits", "root", "parts")
    # A cell of several parts becomes one for each pair of them; a row goes to those of its own part.
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    pair_of = lambda other: F.xxhash64("cell", F.least(part, other), F.greatest(part, other))
    spread = F.when(F.col("parts") <= 1, F.array("cell")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair_of))
    rest = rest.select(F.explode(spread).alias("cell"), "fp", "bits", "root").join(sets, "fp")
    sorted_ = rest.repartition("cell").sortWithinPartitions("cell").select("cell", "fp", "bits", "root", "set")
    return near.unionByName(sorted_.mapInArrow(lambda batches: _compare(batches, similarity, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest id reachable, for each row.

    Null, empty and blank texts are alike; a text of fewer words than a shingle is one shingle.
    Repeated rows share a component, null ids take part, an empty table gives no rows, and other
    columns are not read.
    """
    made = scratch_table(sketches(docs, id_col, text_col), "sketches")
    return simhash.by_component(made.select("doc_id", "fp"), scratch_table(links(made, similarity), "links")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of their component; repeated and null ids as in simhash."""
    return simhash.keep_least(docs, near_duplicates(docs, id_col, text_col, similarity), id_col, text_col)
