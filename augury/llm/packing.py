"""Packing as vector bin packing.

Examples (the ids of a document and an end id) are cut into pieces that fit a sequence by
themselves: full pieces first, then a rest. Full pieces are sequences of their own. The rests of
BLOCK documents are packed together: a sequence is opened and takes, again and again, the piece
that fits under all limits left (tokens, segments, loss-bearing tokens) and has the largest dot
product with what is left of them, each as a share of its limit.

Every task packs what it reads, so no row is shuffled, and holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import batched_texts
from augury.llm.tokens import default_tokenizer, encoder, gather

MAX_TOKENS = 1024
#: Every piece has a token, so this binds only where a caller asks for less.
MAX_SEGMENTS = MAX_TOKENS
BLOCK = 4096
#: Rows that are encoded at once.
ROWS = 1024
#: sequence_id is the task's number times this, plus a count.
PER_TASK = 1 << 40
COLUMNS = "start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def place(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of sizes (n x dimensions); each row is within limits by itself."""
    share = sizes / limits
    # Rows of the same size are interchangeable: one candidate for each distinct size.
    kinds, kind_of = np.unique(share, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    waiting: list[list[int]] = [[] for _ in kinds]
    for row in range(len(sizes) - 1, -1, -1):
        waiting[kind_of[row]].append(row)
    left = np.array([len(w) for w in waiting])
    bins = []
    while len(kinds):
        room, taken = np.ones(sizes.shape[1]), []
        open_kinds = np.arange(len(kinds))
        while True:
            open_kinds = open_kinds[(left[open_kinds] > 0) & (kinds[open_kinds] <= room + 1e-12).all(axis=1)]
            if not len(open_kinds):
                break
            best = int(open_kinds[np.argmax(kinds[open_kinds] @ room)])
            taken.append(waiting[best].pop())
            left[best] -= 1
            room = room - kinds[best]
        if taken:
            bins.append(taken)
        if (gone := left == 0).sum() * 2 > len(kinds) or not left.any():
            keep = np.flatnonzero(~gone)
            kinds, left, waiting = kinds[keep], left[keep], [waiting[k] for k in keep]
    return bins


def _pieces(sizes: np.ndarray, loss: np.ndarray, max_tokens: int, max_loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, loss-bearing tokens) of the pieces of documents of so many tokens, the last `loss` of which bear loss.

    A piece takes as many tokens as the limits allow. Whole pieces before the first token with
    loss and after it are counted, not walked.
    """
    free = sizes - loss
    # Without loss in the way: pieces of max_tokens up to the last one that ends before loss begins.
    plain = free // max_tokens
    rest = sizes - plain * max_tokens  # from here on, the first `lead` tokens bear none
    lead = free - plain * max_tokens
    first = np.minimum(np.minimum(rest, max_tokens), lead + max_loss)
    step = min(max_tokens, max_loss)
    after = rest - first
    more = -(-after // step)
    count = plain + (rest > 0) + more
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p, f, r = plain[doc], first[doc], rest[doc]
    tail = k > p
    start = np.where(tail, p * max_tokens + f + (k - p - 1) * step, k * max_tokens)
    length = np.where(tail, np.minimum(step, sizes[doc] - start), np.where(k == p, f, max_tokens))
    bearing = np.where(tail, length, np.where((k == p) & (r > 0), np.maximum(0, f - lead[doc]), 0))
    return doc, start, length, bearing


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    loss_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    loss_col says how many tokens at the end of a document, its end id not counted, bear loss
    (for example those of an answer); without it, or where it is null, all do. A null text is
    empty: its document is the end id alone. Rows are independent, so repeated rows and null ids
    are packed like any other. An empty table gives no rows; other columns are not read.
    """
    if min(max_tokens, max_segments) < 1 or (max_loss is not None and max_loss < 1):
        raise ValueError("limits must be positive")
    path, most_loss = tokenizer or default_tokenizer(), max_loss or max_tokens
    limits = np.array([max_tokens, max_segments, most_loss], float)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("loss"),
    )
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = encoder(path), TaskContext.get().partitionId() * PER_TASK
        held: list[tuple] = []  # columns of pieces that don't fill a sequence, and their ids
        waiting = 0

        def made(columns: tuple, flat: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            docs_of, start, length, doc_tokens, bearing = columns
            ends = np.concatenate(([0], 4 * np.cumsum(length))).astype(np.int64)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat).astype("<u4", copy=False))])
            numbers = (pa.array(x, pa.int64()) for x in (doc_tokens, bearing, sequence, offset))
            return pa.RecordBatch.from_arrays([docs_of, pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids.cast(pa.binary()), *numbers], names)

        def close() -> pa.RecordBatch:
            """The sequences of what is held."""
            nonlocal number, waiting
            docs_of = pa.concat_arrays([h[0][0] for h in held])
            start, length, doc_tokens, bearing = (np.concatenate([h[0][k] for h in held]) for k in range(1, 5))
            flat = np.concatenate([h[1] for h in held])
            held.clear()
            waiting = 0
            bins = place(np.stack([length, np.ones_like(length), bearing], axis=1).astype(float), limits)
            order = np.array([k for members in bins for k in members], np.int64)
            many = np.array([len(members) for members in bins], np.int64)
            sequence = number + np.repeat(np.arange(len(bins)), many)
            upto = np.cumsum(length[order]) - length[order]
            offset = upto - np.repeat(upto[np.cumsum(many) - many], many)
            number += len(bins)
            begins = np.cumsum(length) - length
            columns = (docs_of.take(pa.array(order)), start[order], length[order], doc_tokens[order], bearing[order])
            return made(columns, gather(flat, begins[order], length[order]), sequence, offset)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat, ends = tok.encode(part.column(1), end_id)
                sizes = np.diff(ends, prepend=0)
                known = part.column(2)
                loss = np.minimum(sizes, np.maximum(0, known.fill_null(0).to_numpy(zero_copy_only=False)) + 1)
                loss = np.where(known.is_null().to_numpy(zero_copy_only=False), sizes, loss)
                doc, start, length, bearing = _pieces(sizes, loss, max_tokens, most_loss)
                place_of = (ends - sizes)[doc] + start

                def columns(which: np.ndarray, doc=doc, part=part, start=start, length=length, sizes=sizes, bearing=bearing) -> tuple:
                    return part.column(0).take(pa.array(doc[which])), start[which], length[which], sizes[doc[which]], bearing[which]

                full = np.flatnonzero(length == max_tokens)
                if len(full):
                    yield made(columns(full), gather(flat, place_of[full], length[full]), number + np.arange(len(full)), np.zeros(len(full), np.int64))
                    number += len(full)
                rest = np.flatnonzero(length < max_tokens)
                held.append((columns(rest), gather(flat, place_of[rest], length[rest])))
                waiting += len(rest)
                if waiting >= BLOCK:
                    yield close()
        if waiting:
            yield close()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"
    return batched_texts(rows).mapInArrow(run, schema)
