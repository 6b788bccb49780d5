"""File scans with explicit schemas, and what guards them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines (gzipped or not); lines that don't parse are kept under CORRUPT."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def split_corrupt(df: DataFrame, drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Rows that parsed, without `drop`, and the counts of all and of corrupt rows from one pass."""
    df = df.cache()  # the corrupt marker alone can't be asked of a JSON scan
    total, corrupt = df.agg(F.count(F.lit(1)), F.count(CORRUPT)).first()
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, *drop), {"total": total, "corrupt": corrupt, "written": total - corrupt}


def check_header(spark: SparkSession, path: str, expected: tuple[str, ...]) -> None:
    """A CSV is read by position, so its header must be exactly what is expected."""
    lines = spark.read.text(path).limit(1).collect()
    found = tuple(lines[0][0].lstrip("﻿").strip().split(",")) if lines else ()
    if found != expected:
        raise ValueError(f"header of {path} is {found}, not {expected}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated with doubled quotes inside quotes, columns by position after the header was checked."""
    check_header(spark, path, tuple(schema.names))
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def hash_sample(df: DataFrame, columns: list[str], parts: int, n: int) -> DataFrame:
    """A deterministic sample: one part of the rows by hash, the n least hashes of it."""
    h = F.xxhash64(*columns)
    return df.where(F.pmod(h, F.lit(parts)) == 0).orderBy(h, *columns).limit(n)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record with the greatest `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file; contents never leave the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_balanced(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Writes files of about the session's advisory partition size, partitioned by `by`.

    The rebalance hint lets the runtime sizes of the shuffle decide: small partitions are joined and a hot value of `by`
    is cut into several files, where a fixed number of partitions would give it one.
    """
    balanced = df.hint("rebalance", *[F.col(c) for c in by]) if by else df.hint("rebalance")
    balanced.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_in_order(df: DataFrame, path: str, order: tuple[str, ...], rows_per_file: int = 1_000_000) -> None:
    """Parquet files whose names ascend with `order`, sorted inside, so that reading file after file gives the order.

    Ranges are sorted side by side by the executors; nothing passes through the driver.
    """
    df.sort(*order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
