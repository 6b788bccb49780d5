"""Shared helpers: reading tables, tables that cut lineage, gapless slots, batches of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[path] = _OWNER.get()
    out = spark.read.schema(df.schema).parquet(path)
    out._sievework_path = path
    return out


#: Tables of this session that `written` made and nobody has deleted, each with its owner.
_TABLES: dict[str, str | None] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that `written` makes inside belong to the owner."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _TABLES[path]


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no later action reads.

    Shuffle files and broadcasts of the steps behind them go with the driver's next collection, so one is asked for: small
    steps fill disks long before they fill the driver.
    """
    gone = [df for df in tables if getattr(df, "_sievework_path", None) in _TABLES]
    for df in gone:
        _delete(df.sparkSession, df._sievework_path)
    if gone:
        gone[0].sparkSession._jvm.System.gc()
        trimmed_worker()  # the driver's Python too


def release(spark: SparkSession, owner: str) -> None:
    """Deletes the tables of the owner; results of anyone else stay."""
    for path in [p for p, o in _TABLES.items() if o == owner]:
        _delete(spark, path)


def gapless(df: DataFrame, group: list[str], order: list[str], buckets: int, name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group is dealt over hash buckets, numbered inside each bucket and shifted by the rows in the
    buckets before, so no task holds a whole group. Rows equal in all of `order` may swap numbers.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, buckets))).cast("int"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    numbered = dealt.withColumn("__inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [*group, "__bucket"])
        .withColumn(name, (F.col("__start") + F.col("__inside")).cast("long"))
        .drop("__bucket", "__inside", "__start")
    )


def utf8_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text: (slice, bytes as uint8, offsets). Null is empty.

    A longer text comes alone, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(_offsets(batch.column(batch.schema.get_field_index(column))))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            data, offsets = utf8(part.column(part.schema.get_field_index(column)))
            yield part, data, offsets
            start = stop


def _plain(column: pa.Array) -> pa.Array:
    if column.null_count:
        column = column.fill_null("")
    return column


def _offsets(column: pa.Array) -> np.ndarray:
    column = _plain(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, the first being 0."""
    column = _plain(column)
    offsets = _offsets(column)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def trimmed_worker() -> None:
    """Gives back what this process, such as a reused Python worker, freed but left with its allocators, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
