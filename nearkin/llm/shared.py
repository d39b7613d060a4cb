"""Helpers that the operators of this package have in common."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on at a time.
STEP_BYTES = 2 << 20

_made: list[str] = []
_tables: list[str] = []
_held: dict[str, Callable[[], None]] = {}
_owner = ""


def own(name: str, release: Callable[[], None] | None = None) -> None:
    """Marks this Python worker as working for an operator; what other operators keep from task to task is dropped."""
    global _owner
    if release:
        _held[name] = release
    if _owner != name:
        for other, drop in _held.items():
            if other != name:
                drop()
        _owner = name
        release_unused()


def release_unused() -> None:
    """Gives freed memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run in one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="nearkin-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/nearkin/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove, spark)
    _made.append(path)
    return path


def drop_at_end(table: str) -> None:
    """The catalog forgets this table when the driver's Python ends; its files lie below the shared folder."""
    _tables.append(table)


def _remove(spark: SparkSession) -> None:
    try:
        for table in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the folder belongs to the cluster
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """row_id and doc, a struct of all columns, stored, so that every scan finds the same numbers whatever executors there are."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), name)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Ranges of rows of about `most` bytes; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
