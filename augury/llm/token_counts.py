"""Token counts by a separator scan over flat, unindexed token files.

A flat file is nothing but ids of fixed width; every document ends with the end-of-document id.
Files are cut into blocks of fixed size, whatever documents they cut. A first pass finds, with
one vectorised search per block, how many separators it has and where the last one stands. A
prefix scan over the blocks of a file turns that into the number of separators before each block
and the place where the document that runs into it began. A second pass gives one row per
separator. No task holds more than a block, and a document may span any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import batched_texts, scratch_path, scratch_table
from augury.llm.files import FILE_TOKENS, read_bytes, write_bytes, write_files
from augury.llm.tokens import default_tokenizer, encoder

END_ID = 50_256
BLOCK_IDS = 1 << 20
#: Ids of the default vocabulary fit 16 bits.
KIND = "<u2"


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, kind: str = KIND) -> DataFrame:
    """Writes flat files of ids, each task those of the rows it reads; their manifest.

    A special token's string in a text is ordinary text, so the end id stands at ends only. The
    manifest's column ids, an array, has the documents of each file in order; the files don't.
    """
    folder = folder or scratch_path(docs.sparkSession, "flat")

    def save(path: str, ids: list, sizes: np.ndarray, tokens: np.ndarray) -> tuple[int, dict]:
        if int(tokens.max(initial=0)) > np.iinfo(kind).max:
            raise ValueError(f"ids of this vocabulary don't fit {kind}")
        write_bytes(path, data := tokens.astype(kind).tobytes())
        return len(data), {"ids": list(ids)}

    extra = f"ids array<{docs.schema[id_col].dataType.simpleString()}>"
    return write_files(docs, id_col, text_col, folder, end_id, save, extra, tokenizer, special_as_text=True, file_tokens=file_tokens, ordered=False)


def _positions(path: str, block: int, block_ids: int, end_id: int, kind: str) -> tuple[np.ndarray, int]:
    """(places in the file of the separators of a block, the block's length in ids)"""
    width = np.dtype(kind).itemsize
    ids = np.frombuffer(read_bytes(path, block * block_ids * width, block_ids * width), kind)
    return np.flatnonzero(ids == end_id) + block * block_ids, len(ids)


def scan(files: DataFrame, end_id: int = END_ID, block_ids: int = BLOCK_IDS, kind: str = KIND) -> DataFrame:
    """One row per document of the files (path, n_bytes): path, ordinal, start, n_tokens, complete.

    ordinal counts a file's documents from 0, start is the place of a document's first id, and
    n_tokens leaves the separator out. Ids after the last separator are a document that is not
    complete. Empty files have no documents. Other columns of files are not read.
    """
    width = np.dtype(kind).itemsize
    last_block = F.expr(f"(n_bytes div {width} - 1) div {block_ids}")
    blocks = files.filter(f"n_bytes >= {width}").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"))
    blocks = blocks.repartition("path", "block")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, size = _positions(path, block, block_ids, end_id, kind)
                rows.append({"path": path, "block": block, "n": len(at), "last": int(at[-1]) if len(at) else None, "size": size})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("block", "n", "last", "size"))]))

    found = scratch_table(blocks.mapInArrow(summarise, "path string, block long, n long, last long, size long"), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumns(
        {
            "first": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "begin": F.coalesce(F.max("last").over(before) + 1, F.lit(0)),
            "tail": F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull(),
        }
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, size = _positions(row["path"], row["block"], block_ids, end_id, kind)
                starts, ends = np.concatenate(([row["begin"]], at + 1)), at
                whole = np.ones(len(at), bool)
                file_end = row["block"] * block_ids + size
                if row["tail"] and starts[-1] < file_end:
                    ends, whole = np.append(at, file_end), np.append(whole, False)
                else:
                    starts = starts[: len(at)]
                if len(ends):
                    ordinals = row["first"] + np.arange(len(ends))
                    columns = [pa.array([row["path"]] * len(ends)), *map(pa.array, (ordinals, starts, ends - starts, whole))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "ordinal", "start", "n_tokens", "complete"])

    rows = scanned.filter("n > 0 OR tail").select("path", "block", "first", "begin", "tail")
    return rows.repartition("path", "block").mapInArrow(emit, "path string, ordinal long, start long, n_tokens long, complete boolean")


def measured(rows: DataFrame, text_col: str, out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """rows with the number of ids of each text in place of the text, counted where the rows are; 0 for null."""
    path = tokenizer or default_tokenizer()
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            _, ends = tok.encode(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.diff(ends, prepend=0), pa.int64())], [*kept, out])

    rows = rows.select(*kept, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{out}` long"])
    return batched_texts(rows).mapInArrow(run, schema)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, kind: str = KIND) -> DataFrame:
    """doc_id and n_tokens of each row, counted in flat files that are written for it.

    Null texts count as empty, with 0 tokens; null ids and repeated rows get a row each. An empty
    table gives no rows.
    """
    manifest = write_flat(docs, id_col, text_col, None, tokenizer, end_id, file_tokens, kind)
    names = manifest.select("path", F.posexplode("ids").alias("ordinal", "doc_id"))
    counted = scan(manifest.select("path", "n_bytes"), end_id, kind=kind)
    # The exploded manifest is as long as the input: never broadcast, whatever its files' size suggests.
    return names.hint("merge").join(counted.withColumn("ordinal", F.col("ordinal").cast("int")), ["path", "ordinal"]).select("doc_id", "n_tokens")
