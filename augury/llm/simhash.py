"""SimHash near-dedup by tiled exact comparison.

Fingerprints. h is the XXH64 (seed 42) of each 3-word shingle; a bit of the fingerprint is set if
it is set in over half of the h. Python workers slice the shingles from one byte string per text
and add the bits up with numpy, in blocks, so that a text of any length needs bounded memory.

Links. Two fingerprints at distance <= r differ by at most r in the sum, over the segments of the
64 bits, of the differences between their population counts. The 64 bits are cut into r + 2
groups of segments; at most r groups can differ, so two groups have all population counts equal.
Tile pairs that share no such pair of groups are never formed: every distinct fingerprint is
dealt to one cell for each pair of groups, keyed by those counts, and only tiles of one cell meet.
A segment is one bit wide by default; its count is the bit itself, so by default the cells are
those of exact matching on 32 of the 64 bits, block permutation by another name. Wider segments
are a parameter and give larger cells. The method proper, skipping by population counts, works inside a
cell: its fingerprints are sorted by population count and cut into tiles; a tile pair whose counts
differ by more than r is skipped, any other is compared exactly with exclusive-or and bit counts.
Cells of one fingerprint link nothing and never reach Python.

A cell gives the edges of a spanning forest, not its pairs: no link between components is lost
and no group gives more edges than members. A cell beyond CELL_ROWS is split into sub-cells, one
for each pair of its parts, so that no task must hold it.

Components come from rounds of large-star and small-star, as Spark joins, on distinct linked
fingerprints only; each round is a table in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import LOWER, UPPER, batched_texts, broadcast_if_small, release_memory, scratch_table

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENT_BITS = 1
TILE = 2048
#: Fingerprints of one cell that are compared in one task.
CELL_ROWS = 20_000
BLOCK = 200_000
#: A key with more than this share of all rows is joined without a shuffle.
SHARE = 0.001
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for a text without words."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_FOLD))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), (ends[size - 1 :] - 1).tolist() if len(words) >= size else [len(line)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        ones += _ones(np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], "<u8"))
    return _over_half(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that over half of them have."""
    ones = sum((_ones(hashes[at : at + BLOCK]) for at in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
    return _over_half(ones, len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
            release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched_texts(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _groups(radius: int, segment_bits: int) -> list[list[int]]:
    """Masks of the segments of each of radius + 2 groups."""
    masks = [((1 << min(segment_bits, 64 - at)) - 1) << at for at in range(0, 64, segment_bits)]
    return [[int(m) for m in part] for part in np.array_split(np.array(masks, dtype=object), radius + 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (unsigned, any order)."""
    counts = np.bitwise_count(fps).astype(np.int16)
    order = np.lexsort((fps, counts))
    fps, counts = fps[order], counts[order]
    root = list(range(len(fps)))
    left, right = [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tiles = [(a, min(a + TILE, len(fps))) for a in range(0, len(fps), TILE)]
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if counts[c] - counts[b - 1] > radius:  # sorted: no later tile can be nearer
                break
            for at in range(a, b, 256):
                near = np.bitwise_count(fps[at : min(at + 256, b), None] ^ fps[None, c:d]) <= radius
                for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                    p, q = find(x + at), find(y + c)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(int(fps[x + at]))
                        right.append(int(fps[y + c]))
    return left, right


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell in, forest edges out; a cell may run over several batches."""
    cell, held, out = None, [], ([], [])

    def close() -> None:
        if sum(map(len, held)) > 1:
            for to, more in zip(out, _forest(np.unique(np.concatenate(held)), radius), strict=True):
                to += more
        held.clear()

    def batch() -> pa.RecordBatch:
        made = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in out]
        for x in out:
            x.clear()
        return pa.RecordBatch.from_arrays(made, ["a", "b"])

    for rows in batches:
        keys, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if keys[a] != cell:
                close()
                cell = keys[a]
            held.append(fps[a:b])
        if out[0]:
            yield batch()
    close()
    if out[0]:
        yield batch()


def links(fps: DataFrame, radius: int = RADIUS, segment_bits: int = SEGMENT_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct values of fp that connect whatever is linked at <= radius bits."""
    distinct = scratch_table(fps.select("fp").distinct(), "fingerprints")
    groups = _groups(radius, segment_bits)

    def counts(k: int) -> list:
        return [F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(m)))) if segment_bits > 1 else F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(k)]

    def masks(k: int) -> list[int]:  # one-bit segments: the bits of a group are its population counts
        return groups[k] if segment_bits > 1 else [sum(groups[k])]

    pairs = list(combinations(range(len(groups)), 2)) if radius else [tuple(range(len(groups)))]
    keys = F.array(*[F.xxhash64(F.lit(n), *[c for k in pair for c in counts(k)]) for n, pair in enumerate(pairs)])
    dealt = distinct.select("fp", F.explode(keys).alias("cell"))
    large = scratch_table(dealt.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")), "cells")
    if not large.isEmpty():
        # A large cell becomes one sub-cell for each pair of parts; a row goes to those of its own part.
        part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
        pair_of = lambda other: F.xxhash64("cell", F.least(part, other), F.greatest(part, other))
        dealt = dealt.join(broadcast_if_small(large), "cell", "left")
        dealt = dealt.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("cell")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair_of))).alias("cell"))
    # The count over a cell has the rows dealt and sorted by cell, as the comparison wants them.
    shared = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("n > 1").select("cell", "fp")
    return shared.mapInArrow(lambda batches: _edges(batches, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Rounds of large-star and small-star until nothing changes; the number of rounds is about the
    logarithm of the longest path. Nothing is collected but one number per round.
    """
    now = scratch_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch_table(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "star")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, fp.

    Rows are linked if their fingerprints differ in at most `radius` bits; component_id is the
    smallest id reachable. Null, empty and blank texts have fingerprint zero and are linked like
    any other. Repeated rows share a component. Null ids take part; a component of null ids alone
    has a null component_id. An empty table gives no rows; other columns are not read.
    """
    prints = scratch_table(fingerprints(docs, id_col, text_col), "prints")
    found = by_component(prints, links(prints, radius))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def by_component(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (doc_id, fp) with component_id, the smallest id that the edges between values of fp reach."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = components(edges)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "copies")
    groups = scratch_table(rooted, "classes")
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    by_print = scratch_table(split_join(groups, ids, "root", "members").select("fp", "component_id", "copies"), "components")
    return split_join(prints, by_print, "fp", "copies").select("doc_id", "fp", "component_id")


def split_join(rows: DataFrame, table: DataFrame, key: str, n: str, share: float = SHARE) -> DataFrame:
    """rows joined with table, which has one row per key and counts in n the rows of that key.

    Keys with more than `share` of all rows, at most 1 / share of them, are broadcast and their rows
    stay where they are; all other rows are shuffled.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often = table.filter(F.col(n) > share * total).drop(n)
    rare = table.filter(F.col(n) <= share * total).drop(n)
    heavy = rows.join(F.broadcast(often), key)
    light = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key)
    return heavy.unionByName(light)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of their component.

    Of rows repeated under that id with one text, one stays; an id whose rows have different texts
    stays if one of them does. Null counts as one id: it stays if a component has null ids only.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id is its own component_id in found (doc_id, component_id)."""
    by_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("rows"))
    by_id = scratch_table(by_id.filter("NOT stays OR rows > 1"), "lost")
    lost = broadcast_if_small(by_id.filter("NOT stays").select(F.col("doc_id").alias("__id")))
    out = docs.join(lost, docs[id_col].eqNullSafe(lost["__id"]), "left_anti")
    repeated = by_id.filter("stays").select(F.col("doc_id").alias("__id"))
    if repeated.isEmpty():
        return out
    again = broadcast_if_small(repeated)
    once = out.join(again, out[id_col].eqNullSafe(again["__id"]), "left_semi").dropDuplicates([id_col, text_col])
    return out.join(again, out[id_col].eqNullSafe(again["__id"]), "left_anti").unionByName(once)
