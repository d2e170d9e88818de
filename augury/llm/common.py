"""What the corpus operators share: scratch tables, text expressions, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space between words: blank and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many rows of at most a few dozen bytes each.
BROADCAST_ROWS = 500_000
BATCH_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/augury-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/augury-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    _made.append((spark, path))
    return path


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut, and any executor may go."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes, at its end, the scratch paths made within; what was computed from them must have been written by then."""
    before = len(_made)
    try:
        yield
    finally:
        drop_scratch(before)


def drop_scratch(keep: int = 0) -> None:
    """Removes the scratch paths of this driver but the first `keep`. Frames that still read them must not be used any more."""
    while len(_made) > keep:
        spark, path = _made.pop()
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        if jvm is None or jsc is None:
            return
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def batched_texts(rows: DataFrame) -> DataFrame:
    """rows, after bounding what one Arrow batch holds in the session: whole texts are long, and every task has a batch."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).removesuffix("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def release_memory() -> None:
    """Gives back what a Python worker has freed; workers live on between tasks and else keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() has a fast way for ASCII strings, where both agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """array<string> of the words, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it, else df as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df
