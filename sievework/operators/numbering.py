"""Numbers of rows in a global order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.scratch import written


def number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based numbers by `order` (which must be total).

    Range partitions are numbered inside and shifted by the rows before them: one count for each partition meets.
    The partitions are written first, as a second sampling could draw other ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__i", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__i")).drop("__part", "__i", "__start")


def numbered_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The running sum of `value` by `order` (which must be total), this row included, dealt as in `number`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "summed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.sum(value).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__i", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__i")).drop("__part", "__i", "__start")
