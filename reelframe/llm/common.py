"""Helpers that several operators share: the shared folder, lineage cuts and Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A broadcast side may have this many rows at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python worker handles at once; a longer single text is a batch of its own.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local one if there is one machine only; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation. Spark removes them once no table is made from them any more."""
    shared_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that can be removed together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        """The same rows as a table."""
        path = f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most: Python objects are made of one slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back to the system at its end: Python workers live on between stages."""

    @functools.wraps(f)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where a small input has fewer partitions than these; large inputs stay as they are.

    A file of one row group is one task, however many cores wait. For tables as they are read: of a
    frame with shuffles, the count of partitions is known only once these have run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows whose texts have ``most`` bytes at most, or one row.

    Null texts count as empty. The bytes are a view of the Arrow buffer: no copy is made.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as signed ones, which is what Spark has."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def long_lists(matrix: np.ndarray) -> pa.Array:
    """A list of longs for each row of the matrix."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), longs(np.ascontiguousarray(matrix).reshape(-1)))
