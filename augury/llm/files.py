"""Token files in the shared folder, written and read by Python workers through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from augury.llm.common import batched_texts, scratch_table
from augury.llm.tokens import default_tokenizer, encoder

#: A file is closed when it has so many ids.
FILE_TOKENS = 2_000_000
#: Bytes of files that one task reads, where there are more files than a few for each core.
TASK_BYTES = 256 << 20
MANIFEST = "part long, file long, path string, n_docs long, n_tokens long, n_bytes long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path; some schemes have other names there."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if path.startswith(ours):
            path = theirs + path[len(ours) :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    """Writes under another name first, so that a file is there whole or not at all."""
    system, at = _place(path)
    with system.open_output_stream(f"{at}.part") as out:
        out.write(data)
    system.move(f"{at}.part", at)


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, at = _place(path)
    with system.open_input_file(at) as file:
        file.seek(start)
        return file.read(size) if size is not None else file.read()


def make_folder(path: str) -> None:
    system, at = _place(path)
    system.create_dir(at, recursive=True)


def write_files(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    folder: str,
    end_id: int,
    save: Callable[[str, list, np.ndarray, np.ndarray], tuple[int, dict]],
    extra: str = "",
    tokenizer: str | None = None,
    special_as_text: bool = False,
    file_tokens: int = FILE_TOKENS,
    ordered: bool = True,
) -> DataFrame:
    """Encodes all texts into files; their manifest.

    Ordered: in ascending order of id, nulls first. Rows are dealt by ranges of the id, a hash of
    the text and the row's place in the input, so that rows of one id, or without one, need not be
    one task; rows with one id are in that order. The files of a task follow those of the task
    before. Not ordered: every task writes what it reads, and no text is shuffled.
    save(path, ids, sizes, tokens) writes the documents' tokens, one after another, and returns the file's
    size and the values of the columns `extra`. Names are unique for each attempt: files of a lost
    task are not in the manifest.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if ordered:
        order = ["id", "tie", "row"]
        rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    schema = f"{MANIFEST}{', ' if extra else ''}{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_folder(folder)
        tok, part = encoder(path, special_as_text), TaskContext.get().partitionId()
        ids: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = count = 0

        def close() -> pa.RecordBatch:
            nonlocal held, count
            name = f"{folder}/{part:06d}-{count:05d}-{uuid.uuid4().hex[:12]}.tok"
            n_bytes, more = save(name, ids, np.concatenate(sizes), np.concatenate(tokens))
            row = {"part": part, "file": count, "path": name, "n_docs": len(ids), "n_tokens": held, "n_bytes": n_bytes, **more}
            for part_of in (ids, sizes, tokens):
                part_of.clear()
            held, count = 0, count + 1
            return pa.RecordBatch.from_pylist([row], arrow_schema)

        for batch in batches:
            docs_of, (flat, ends) = batch.column(0).to_pylist(), tok.encode(batch.column(1), end_id)
            at, begin = 0, 0
            while at < len(docs_of):
                upto = min(len(docs_of), int(np.searchsorted(ends, begin + file_tokens - held, "left")) + 1)
                ids += docs_of[at:upto]
                sizes.append(np.diff(ends[at:upto], prepend=begin))
                tokens.append(flat[begin : ends[upto - 1]])
                held += int(ends[upto - 1]) - begin
                at, begin = upto, int(ends[upto - 1])
                if held >= file_tokens:
                    yield close()
        if ids:
            yield close()

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return scratch_table(batched_texts(rows).mapInArrow(run, schema), "manifest")


def deal_files(manifest: DataFrame) -> DataFrame:
    """The manifest's rows dealt over tasks: a few files each while there are few, else by their bytes."""
    n, size = manifest.selectExpr("count(*)", "coalesce(sum(n_bytes), 0)").first()
    tasks = max(min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    return manifest.repartition(max(1, tasks), "path")
