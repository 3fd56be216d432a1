"""Shared folders, table access and Arrow helpers for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


ROWS_AT_ONCE = 2000  # of an Arrow batch, so that batches of long texts stay small


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a temporary folder is set once and kept for
    the session, on one machine alone; a cluster must name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/weftline-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage
    and survives the loss of executors. What earlier steps shuffled is then garbage, and Spark's
    cleaner removes those files once the driver has collected it. The table is deleted by ``release``, or when the
    session's process ends."""
    spark, schema, path = df.sparkSession, df.schema, shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    at_exit(spark, path)
    return out


def store(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder of intermediate data deleted when the session's process ends."""
    fs, at = store(spark, path)
    fs.deleteOnExit(at)


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            fs, at = store(df.sparkSession, path)
            fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def texts(column: pa.Array) -> list[str]:
    """Python strings of a string column; null becomes the empty string."""
    return pc.fill_null(column, "").to_pylist()


def bounded_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose ``column`` holds about ``most_bytes`` bytes at most
    (a longer single text is a slice of its own)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at, ends = 0, np.cumsum(lengths)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offsets (rows + 1) into them; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]
