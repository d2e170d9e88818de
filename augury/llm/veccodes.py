"""Vector codes: product quantisation in integers, with partial-distance search.

Components become integers, vectors are cut into parts, and each part has a codebook of a few
entries. A search goes through a part's dimensions in descending variance of the codebook's
entries: each pair of a vector and an entry gathers its squared distance dimension by dimension
and is dropped as soon as that strictly exceeds the vector's best complete distance. Training
repeats a search over all vectors; only sums per (part, entry, dimension) leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import batched_texts, scratch_table, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within so many units of 1 / SCALE, so that squared distances stay exact in 64 bits.
LIMIT = 1 << 28
#: Vectors searched at once.
BLOCK = 4096
#: Labels with over 1 / HOT_LABELS of the rows are looked up without a shuffle.
HOT_LABELS = 1000


@dataclass
class Codebooks:
    """One int64 array (entries, dimensions of the part) for each part."""

    books: list[np.ndarray]

    @property
    def dims(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position within the part, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes (n, parts), squared distance of each part (n, parts)) of the rows of an integer array."""
        codes, errors = np.zeros((len(vectors), len(self.books)), np.int64), np.zeros((len(vectors), len(self.books)), np.int64)
        at = 0
        for k, book in enumerate(self.books):
            part = vectors[:, at : at + book.shape[1]].astype(np.int64)
            for i in range(0, len(part), BLOCK):
                codes[i : i + BLOCK, k], errors[i : i + BLOCK, k] = nearest(part[i : i + BLOCK], book)
            at += book.shape[1]
        return codes, errors


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each row of x; ties go to the lower index."""
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    gathered = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    # The entry that is nearest in the first dimension gives each row its first complete distance.
    best = ((x - book[gathered.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(gathered <= best[:, None])
    so_far = gathered[row, entry]
    for j in order[1:]:
        so_far = so_far + (x[row, j] - book[entry, j]) ** 2
        left = so_far <= best[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    # What is left is complete; pairs are still in the order of rows and entries, and each row has one at least.
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if n else np.zeros(0, np.int64)
    best = np.minimum.reduceat(so_far, starts) if n else best
    hit = np.flatnonzero(so_far == best[row])
    _, first = np.unique(row[hit], return_index=True)
    return entry[hit[first]], best


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, dims, v: floor(scale * x) of each component as little-endian 32-bit integers.

    Rows whose vector is null or empty, or holds a null or non-finite component, are left out.
    Components beyond LIMIT / scale count as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            keep = (length > 0) & (bad[ends] == bad[ends - length])
            of = flat[np.repeat(keep, length)]
            ints = np.clip(np.floor(scale * of), -LIMIT, LIMIT).astype("<i4")
            offsets = np.concatenate(([0], np.cumsum(4 * length[keep]))).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(ints.tobytes())])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(length[keep].astype(np.int32)), binary], ["vec_id", "label", "dims", "v"]
            )

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return batched_texts(rows).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dims int, v binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims)


def first_codebooks(ints: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids, null ids last, equal ids by their bytes."""
    rows = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows
    vectors = np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(-1, dims)
    return Codebooks([np.ascontiguousarray(p) for p in np.array_split(vectors, parts, axis=1)])


def refined(ints: DataFrame, books: Codebooks) -> Codebooks:
    """After one round: each entry is the floored mean of the parts that are nearest to it; unused entries stay."""
    shared = ints.sparkSession.sparkContext.broadcast(books)  # parts x entries x dimensions of a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.books]  # the last place counts
        for batch in batches:
            vectors = _matrix(batch.column(0), books.dims).astype(np.int64)
            codes, _ = books.assign(vectors)
            at = 0
            for k, total in enumerate(totals):
                width = total.shape[1] - 1
                np.add.at(total[:, :width], codes[:, k], vectors[:, at : at + width])
                total[:, width] += np.bincount(codes[:, k], minlength=len(total))
                at += width
        for k, total in enumerate(totals):
            entry, place = np.nonzero(total)
            columns = [np.full(len(entry), k), entry, place, total[entry, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total"])

    sums = ints.select("v").mapInArrow(run, "part long, entry long, place long, total long")
    out = [np.zeros((len(b), b.shape[1] + 1), object) for b in books.books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect():  # entries x (dims + parts) rows
        out[r.part][r.entry, r.place] = int(r.total)
    new = []
    for old, total in zip(books.books, out, strict=True):
        width = old.shape[1]
        new.append(np.array([[total[e, j] // total[e, width] for j in range(width)] if total[e, width] else old[e] for e in range(len(old))], np.int64).reshape(old.shape))
    return Codebooks(new)


def train(ints: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_codebooks(ints, dims, parts, entries)
    for _ in range(rounds):
        books = refined(ints, books)
    return books


def coded(ints: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (a byte for each part), error (squared distances summed over parts)."""
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = shared.value.assign(_matrix(batch.column(2), shared.value.dims))
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    rows = ints.select("vec_id", "label", "v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decoded(code: bytes, books: Codebooks) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book[c] for book, c in zip(books.books, code, strict=True)])


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over equal labels, nulls together.

    Sums are few and broadcast, or else those of labels with many rows are, at most HOT_LABELS of
    them, and the other rows are shuffled.
    """
    sums = scratch_table(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-sums")
    same = F.col("label").eqNullSafe(F.col("of"))
    if small(sums):
        return rows.join(F.broadcast(sums), same).drop("of", "n")
    least = sums.agg(F.sum("n")).first()[0] / HOT_LABELS
    hot = F.broadcast(sums.filter(F.col("n") > least))  # fewer than HOT_LABELS rows
    heavy, light = rows.join(hot, same), rows.join(hot, same, "left_anti").join(sums, same)
    return heavy.unionByName(light).drop("of", "n")


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, label_error; codebooks), a row for each vector that is kept.

    Vectors that are null or empty, or hold null or non-finite components, are dropped; so are those
    whose length is not the most frequent one (of equally frequent ones the largest). If the length
    is no multiple of `parts`, the first parts have one dimension more. With fewer vectors than
    `entries` the codebooks are that small. Repeated rows and ids each get a row, null ids and
    labels stay null, other columns are not read. Without any vector there are no codebooks and no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code has a byte for each part")
    ints = scratch_table(integer_vectors(vectors, id_col, vec_col, label_col, scale), "vectors")
    common = ints.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        kinds = {f.name: f.dataType.simpleString() for f in ints.schema.fields}
        return ints.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long, label_error long"), None
    ints = ints.filter(F.col("dims") == common["dims"])
    books = train(ints, common["dims"], parts, entries, rounds)
    return with_label_error(scratch_table(coded(ints, books), "codes")), books
