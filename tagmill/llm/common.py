"""Shared helpers of the training-data operators: scratch folders, Arrow slices, small maths."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a temporary folder serves a session of one machine; on a
    cluster that would be a folder that executors don't share, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tagmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class _Open(threading.local):
    """Per thread the open workspaces (what they delete), and which path a materialised table has."""

    def __init__(self):
        self.spaces: list[list[str]] = []
        self.paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


_open = _Open()


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of executors.

    In a ``workspace`` the table lasts as long as that; with ``keep`` as long as the next one around it.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _open.paths[out] = path
    if len(_open.spaces) > keep:
        _open.spaces[-1 - keep].append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = _open.paths.pop(df, None)
        if path is not None:
            drop_path(df.sparkSession, path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is materialised in the block is deleted at its end, also if it fails."""
    _open.spaces.append([])
    try:
        yield
    finally:
        for path in _open.spaces.pop():
            drop_path(spark, path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that go to a Python worker at once. Whole texts are long; Spark's own 10,000 rows of them would be held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session from now on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; at a task's end the worker, which waits for the next task, gives free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows whose text is about ``max_bytes`` at most; one long row stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    offsets = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(offsets.tolist()):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def two_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only key and text, under fixed names, so that clashing extra columns play no part."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


#: Ids that are sent to every task at most.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows, with all their columns, whose id isn't in the single column of ``ids``; rows without an id stay.

    Few ids are broadcast, so that texts stay where they are; more are joined by a shuffle that doesn't sort the texts.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("__gone")).filter("__gone IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), docs[key] == ids["__gone"], "left_anti")
