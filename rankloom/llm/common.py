"""Helpers of the operators: the shared folder, written intermediate tables, Arrow slices, name choice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes and rows that a Python step works on at once; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 3 << 20, 300
#: Most rows of the Arrow batches that carry texts to Python.
BATCH_ROWS = 1000


_FOLDERS: dict[str, str] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that would lose data, so it is
    refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="rankloom-")
        found = _FOLDERS[app]
    return found.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for a table that goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/rankloom-{uuid.uuid4().hex}/{label}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, label: str, compression: str = "snappy", row_group: int = 0) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: its lineage ends there.

    The folder goes when the session's JVM ends. row_group: bytes of Parquet's row groups, if not as set.
    """
    spark = df.sparkSession
    path = place(spark, label)
    writer = df.write.option("compression", compression)
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of the jobs that made it, which nothing needs any more
    return spark.read.parquet(path)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_ROWS rows, as rows here hold whole texts; the session keeps that."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0") or 0) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


_KEPT: dict[tuple, object] = {}


def kept(*name: object, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps from task to task: one thing at a time, made when first asked for by that name.

    Workers are used again by other steps; without `make` nothing is kept, so that a step finds the memory free.
    """
    if name not in _KEPT:
        _KEPT.clear()
        if make:
            _KEPT[name] = make()
    return _KEPT.get(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most `rows` and SLICE_BYTES of text (one row at least), null texts as
    empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        batch = batch.set_column(k, column, pc.fill_null(batch.column(k), ""))
        ends = np.cumsum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            limit = SLICE_BYTES + (ends[at - 1] if at else 0)
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, limit, "right"))))
            yield batch.slice(at, to - at)
            at = to


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary Arrow array: row i holds the bytes of values[ends[i-1]:ends[i]]."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = np.asarray(ends, np.int64) * values.dtype.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), data]).cast(pa.binary())
