"""A ledger of runs: appends that a retried task, a repeated call or a replayed micro-batch don't double.

Rows lie in a folder for each run and batch. An append replaces that folder alone, under Spark's commit protocol, so the
same batch twice leaves the same table and other batches are never rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run_id", "batch")


def append(rows: DataFrame, path: str, run_id: str, batch: int) -> None:
    """Creates the ledger or adds the batch to it. rows without a row leave no folder, and none of an earlier call."""
    clash = set(KEYS) & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the ledger's own")
    keyed = rows.withColumns({"run_id": F.lit(run_id), "batch": F.lit(batch).cast("long")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows with run_id (string) and batch (long)."""
    df = spark.read.parquet(path)
    return df.withColumns({"run_id": F.col("run_id").cast("string"), "batch": F.col("batch").cast("long")})


def sink(path: str, run_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch that is replayed after a failure replaces itself."""
    return lambda rows, batch: append(rows, path, run_id, batch)


def latest_run(ledger: DataFrame, qualifies=None) -> DataFrame:
    """The rows of the greatest run_id among those that have a qualifying row; of none, no rows."""
    good = ledger if qualifies is None else ledger.where(qualifies)
    return ledger.join(F.broadcast(good.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")
