"""Streaming forms of the stateless gate, of event windows and of the late-data merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.contracts import Contract, gate
from sievework.operators.maintenance import merge_late
from sievework.sources.versions import Catalog


def gated(stream: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """The gate has no state, so it takes streams as they are."""
    return gate(stream, contract)


def window_counts(stream: DataFrame, ts: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Events and users per window; rows later than the watermark are left to the merge."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size)).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))


def merge_sink(catalog: Catalog, table: str, keys: list[str]):
    """For foreachBatch: each micro-batch is merged as a version; a repeated batch changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            merge_late(catalog, table, batch.dropDuplicates(keys), keys)

    return run
