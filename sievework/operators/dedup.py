"""Exact duplicates, latest rows, content hashes and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import canonical


def drop_exact(df: DataFrame) -> DataFrame:
    """Rows equal in all columns once; nulls are equal."""
    return df.dropDuplicates()


def keep_latest(df: DataFrame, keys: list[str], ts: str, ties: list[Column], few: bool = False) -> DataFrame:
    """The last row of each key by ts, then by `ties`; a limit on the rank lets Spark drop rows before the shuffle.

    The limit costs a sort on either side of the shuffle; with `few` superseded rows only the second one is made.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *ties)
    if few:
        return df.withColumn("__later", F.lag(F.lit(1)).over(w)).where("__later is null").drop("__later")
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[canonical(f.name, f.dataType.simpleString()) for f in df.schema])


def content_hash(df: DataFrame) -> DataFrame:
    """rows and the sum of row hashes: equal for equal contents in any order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_hash(df).cast("decimal(38,0)")), F.lit(0)).alias("hash"))


def compare_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(table, rows, hash) of two runs: identical, different, missing or unreferenced."""
    x, y = a.alias("x"), b.alias("y")
    same = (F.col("x.rows") == F.col("y.rows")) & (F.col("x.hash") == F.col("y.hash"))
    status = F.when(F.col("y.table").isNull(), "missing").when(F.col("x.table").isNull(), "unreferenced").when(same, "identical").otherwise("different")
    return x.join(y, F.col("x.table") == F.col("y.table"), "full_outer").select(F.coalesce("x.table", "y.table").alias("table"), status.alias("status"))


def difference(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of one side only, with multiplicity: side, then the columns.

    Both sides are counted in one pass, left rows up and right rows down. With n partitions a task's groups stay as
    many as n makes them.
    """
    both = a.withColumn("__d", F.lit(1)).union(b.withColumn("__d", F.lit(-1)))
    net = (both.repartition(n, *a.columns) if n else both).groupBy(*a.columns).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    times = F.explode(F.array_repeat(F.when(F.col("__d") > 0, "left").otherwise("right"), F.abs("__d").cast("int")))
    return net.select(*a.columns, times.alias("side"))


def tie_groups(df: DataFrame, keys: list[str], ts: str, n: int | None = None) -> DataFrame:
    """Keys whose latest instant holds several rows, with how many.

    Rows of an instant are counted, then the count of the last instant is taken: no rows of a key are sorted or kept. With
    n partitions a task's groups stay as many as n makes them, and one shuffle serves both.
    """
    per = (df.repartition(n, *keys) if n else df).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.max_by("n", ts).alias("n")).where("n > 1")
