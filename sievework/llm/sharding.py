"""Operator 1: K-d tree sharding by bytes, DataFrame functions only.

The metadata of a document is a point (language, source, log size, id). A node of the tree is split at
the weighted median of its widest dimension until every leaf holds about the target bytes. A median is
found by radix narrowing: histograms of a 62-bit key (dimension value, then a hash that breaks ties) are
counted by Spark and only a bounded number of bins reaches the driver, so no node is ever sorted or
gathered, however many rows share one value.

Nulls: a null text has no bytes, a null metadata value lies below all others. Equal points are parted by the
hash of (doc_id, text_crc32); rows equal in both stay together. An empty table gives an empty result. Only
the named columns are read, so further columns of the input can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import gapless, table, written

OVERHEAD = 16
BINS = 4096
TIE_BITS = 42
DIM_BITS = 20
ROWS_PER_BUCKET = 20_000


def _ordinal(c: Column) -> Column:
    """The first six bytes of a string as a number, in the strings' order."""
    return F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.coalesce(c, F.lit("")).cast("binary"), 1, 6), 6, b"\x00")), 16, 10).cast("double"), F.lit(0.0))


def points(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions d0.. as doubles; the text itself stays where it is."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        _ordinal(F.col("lang")).alias("d0"), _ordinal(F.col("source")).alias("d1"), F.log2(size.cast("double")).alias("d2"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d3"),
    )


def _small(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of at most as many rows as there are shards, to broadcast."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({columns})"))


def kd_shards(points: DataFrame, target_bytes: float | None = None, shards: int | None = None, dims: int = 4) -> DataFrame:
    """`points` with `shard`: leaves of about `target_bytes` (or just so many `shards`)."""
    total, *ends = points.agg(F.sum("size"), *[f(f"d{i}") for i in range(dims) for f in (F.min, F.max)]).first()
    if total is None:
        return points.withColumn("shard", F.lit(0))
    shards = shards or max(1, round(total / target_bytes))
    scaled = points
    for i, (low, high) in enumerate(zip(ends[::2], ends[1::2], strict=True)):
        scaled = scaled.withColumn(f"d{i}", ((F.col(f"d{i}") - low) / (high - low or 1.0) * (2**DIM_BITS - 1)).cast("long"))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2**TIE_BITS))
    tree = written(scaled.select("doc_id", "size", "text_crc32", *[f"d{i}" for i in range(dims)], tie.alias("tie"), F.lit(0).alias("node")), "points")
    leaves = [(0, shards)]  # of each node: its first shard and how many
    while any(n > 1 for _, n in leaves):
        tree, leaves = _split(tree, leaves, dims)
    names = _small(points.sparkSession, "node, shard", [(node, first) for node, (first, _) in enumerate(leaves)])
    return tree.join(names, "node")


def _split(tree: DataFrame, leaves: list[tuple[int, int]], dims: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """One level: each node of several shards in two, near its weighted median."""
    seen = {r["node"]: r for r in tree.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))]).collect()}
    ask, kept, born = {}, [], []
    for node, (first, n) in enumerate(leaves):
        r, at = seen.get(node), len(born)
        d = max(range(dims), key=lambda i: r[f"high{i}"] - r[f"low{i}"]) if r else 0
        if n > 1 and r:
            # the key may lie in [low, high); bytes wanted below the cut that lie above low
            ask[node] = [r[f"low{d}"] << TIE_BITS, (r[f"high{d}"] + 1) << TIE_BITS, r["bytes"] * (n // 2) / n]
        kept.append((node, d, at))
        born += [(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, n)]
    spark = tree.sparkSession
    along = F.element_at(F.array(*[F.col(f"d{i}") for i in range(dims)]), F.col("dim") + 1)
    keyed = tree.join(_small(spark, "node, dim, born", kept), "node").withColumn("key", F.shiftleft(along.cast("long"), TIE_BITS) + F.col("tie"))
    cuts = _medians(keyed, ask)
    limits = _small(spark, "node, cut", [(node, cuts.get(node, 2**62)) for node in range(len(leaves))])
    parted = keyed.join(limits, "node").withColumn("node", F.col("born") + (F.col("key") >= F.col("cut")).cast("int"))
    return written(parted.drop("key", "dim", "born", "cut"), "tree"), born


def _medians(keyed: DataFrame, ask: dict[int, list]) -> dict[int, int]:
    """For each node the key at which the bytes below come nearest to what is wanted."""
    cuts, open_ = {}, dict(ask)
    while open_:
        ranges = _small(keyed.sparkSession, "node, low, high, step", [(n, low, high, -(-(high - low) // BINS)) for n, (low, high, _) in open_.items()])
        inside = keyed.join(ranges, "node").where("key >= low and key < high")
        bins = inside.groupBy("node", F.expr("(key - low) div step").alias("bin"))
        found: dict[int, list] = {}
        for r in bins.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")).collect():
            found.setdefault(r["node"], []).append(r)
        for n in list(open_):
            _, _, want = open_.pop(n)
            for r in sorted(found[n], key=lambda r: r["bin"]):
                if want > r["bytes"]:
                    want -= r["bytes"]
                elif r["first"] == r["last"]:
                    cuts[n] = r["first"] if want < r["bytes"] / 2 else r["first"] + 1
                    break
                else:
                    open_[n] = [r["first"], r["last"] + 1, want]
                    break
            else:
                cuts[n] = max(r["last"] for r in found[n]) + 1
    return cuts


def shard(docs: DataFrame, target_bytes: float | None = None, shards: int | None = None) -> DataFrame:
    """Documents' ids with shard and a slot inside it, gapless from 0."""
    tree = kd_shards(points(docs), target_bytes, shards)
    n = tree.count()
    return gapless(tree.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32"], max(1, min(65_536, n // ROWS_PER_BUCKET // max(1, shards or 1))))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """The documents as one folder for each shard, in slot order inside a file."""
    wide = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    wide.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_kd_sharding": op1}
