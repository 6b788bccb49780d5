"""Table operations over versions: backfill, append, late merge, fragment, compact, time travel, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.times import half_open, hash_share
from sievework.sources.versions import Catalog


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("ts", "yyyy-MM"))


def backfill(catalog: Catalog, df: DataFrame, table: str, start: str, end: str, holdout: int = 0) -> dict:
    """[start, end) by month, less a hash share (of 1000) that arrives late."""
    rows = df.where(half_open(F.col("ts"), start, end))
    kept = rows.where(~hash_share(["user_id", "item_id", "ts"], 1000, holdout))
    return catalog.publish(with_month(kept), table, "backfill", ("month",), {"start": start, "end": end})


def append_month(catalog: Catalog, df: DataFrame, table: str, month: str) -> dict:
    """One month; months that are there already are refused."""
    old = catalog.read(table)
    if not old.where(F.col("month") == month).isEmpty():
        raise ValueError(f"{table} has {month}")
    new = with_month(df).where(F.col("month") == month)
    rows = new.count()
    m = catalog.publish(old.unionByName(new), table, "append", ("month",))
    if m["rows"] != catalog.manifest(table, m["parent"])["rows"] + rows:
        raise AssertionError(f"{table}: {m['rows']} rows after an append of {rows}")
    return m


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows take the source's values, others are added; source keys must be unique."""
    rest = [c for c in target.columns if c not in keys]
    s = source.select(*keys, F.struct(*rest).alias("__new"))
    t = target.select(*keys, F.struct(*rest).alias("__old"))
    return t.join(s, keys, "full_outer").select(*keys, F.coalesce("__new", "__old").alias("r")).select(*keys, "r.*").select(*target.columns)


def merge_late(catalog: Catalog, table: str, source: DataFrame, keys: list[str]) -> dict:
    return catalog.publish(merge(catalog.read(table), with_month(source), keys), table, "merge", ("month",))


def fragment_month(catalog: Catalog, table: str, month: str) -> dict:
    """The month as one file for each day."""
    df = catalog.read(table)
    days = F.when(F.col("month") == month, F.dayofmonth("ts")).otherwise(0)
    return catalog.publish(df.repartition(31, "month", days), table, "fragment", ("month",))


def compact(catalog: Catalog, table: str, target_bytes: int = 128 << 20) -> dict | None:
    """As few files for each month as the target allows; nothing to do is no new version."""
    files = catalog.files(table).withColumn("month", F.regexp_extract("path", "month=([^/]+)", 1)).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    plan = files.withColumn("want", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)))
    if plan.where("n > want").isEmpty():
        return None
    df = catalog.read(table).join(F.broadcast(plan.select("month", "want")), "month")
    salt = F.pmod(F.xxhash64("user_id", "item_id", "ts"), F.col("want"))
    return catalog.publish(df.repartition("month", salt).drop("want"), table, "compact", ("month",))


def lineage(catalog: Catalog, tables: list[str]) -> DataFrame:
    """One row for each version of each table: rows in and out, seconds; `steps` records bytes and files too."""
    out = None
    for t in tables:
        h = catalog.history(t).alias("h")
        p = h.select(F.col("version").alias("pv"), F.col("rows").alias("rows_in"))
        rows = h.join(p, F.col("parent") == F.col("pv"), "left").select(F.lit(t).alias("table"), "version", "operation", "rows_in", F.col("rows").alias("rows_out"), "wall_s")
        out = rows if out is None else out.unionByName(rows)
    return out
