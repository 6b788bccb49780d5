"""The domain's tables over the star schema: interactions, items, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.times import DEEP, DEEP_EDGES, MAIN, SEGMENT_EDGES, SEGMENTS, SPARSE, Splits, bucket
from sievework.operators.dedup import keep_latest

KEYS = ["user_id", "item_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of `lineitem` for each partition where a task's memory must not grow with the table.
PART_ROWS = 500_000


def parts(spark: SparkSession, sf: str) -> int:
    """Partitions that deal the lines by PART_ROWS; the count is read from the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf, "lineitem").count() // PART_ROWS))


def raw(spark: SparkSession, sf: str, n: int | None = None) -> DataFrame:
    """The lines with their user; n partitions where given."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    if n:
        line, order = line.repartition(n, "l_orderkey"), order.repartition(n, "o_orderkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("ts"), F.ceil(F.col("l_quantity") / 10).cast("long").alias("rating"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("linenumber"), F.col("l_extendedprice").alias("price"),
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    return keep_latest(raw(spark, sf), KEYS, "ts", [F.col("orderkey"), F.col("linenumber")])


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    """The interactions, dealt by user: what is grouped by user later leaves a task as one row for each user."""
    n = parts(spark, sf)
    return keep_latest(raw(spark, sf, n).repartition(n, "user_id"), KEYS, "ts", [F.col("orderkey"), F.col("linenumber")], few=True)


def pairs(spark: SparkSession, sf: str, splits: Splits, timed: bool = False) -> DataFrame:
    """(user_id, item_id, split) of the interactions, dealt by user; `timed` with their ts.

    Splits follow each other in time, so the split of a pair's latest line is the latest split of its lines: a line is
    a stage of one byte when it meets its order, and no line is sorted. Its ts is the latest one of its lines.
    """
    extra = ["ts"] if timed else []
    n = parts(spark, sf)
    line = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), splits.stage(F.col("l_shipdate")).alias("stage"), *[F.col("l_shipdate").alias(c) for c in extra])
    order = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    met = line.repartition(n, "l_orderkey").join(order.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    last = met.select("user_id", "item_id", "stage", *extra).repartition(n, "user_id").groupBy("user_id", "item_id").agg(*[F.max(c).alias(c) for c in ("stage", *extra)])
    return last.select("user_id", "item_id", F.when(F.col("stage") == 1, "train").when(F.col("stage") == 2, "val").when(F.col("stage") == 3, "test").alias("split"), *extra)


def _split(inter: DataFrame, splits: Splits) -> Column:
    return F.col("split") if "split" in inter.columns else splits.label(F.col("ts"))


def part_of(inter: DataFrame, splits: Splits, label: str) -> DataFrame:
    """The rows of a split, of interactions or of `pairs` of these splits."""
    return inter.where(_split(inter, splits) == label)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))


def segments(inter: DataFrame, splits: Splits) -> DataFrame:
    n = inter.groupBy("user_id").agg(F.count_if(_split(inter, splits) == "train").alias("n_train"))
    return n.select("user_id", "n_train", bucket(F.col("n_train"), SEGMENT_EDGES, SEGMENTS).alias("segment"), bucket(F.col("n_train"), DEEP_EDGES, DEEP).alias("deep"))


def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("item_id"), F.col("doc_id").alias("user_id"), F.col("text").alias("tags"))


#: The same tables for SQL.
RAW = """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_shipdate AS ts, CAST(ceil(l_quantity / 10) AS BIGINT) AS rating,
 l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
INTER = RAW + """,
inter AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, orderkey, linenumber) = 1)"""


def labelled(splits: Splits) -> str:
    return INTER + f""",
lab AS (SELECT *, CASE WHEN ts <= TIMESTAMP '{splits.train_end}' THEN 'train' WHEN ts <= TIMESTAMP '{splits.val_end}' THEN 'val' WHEN ts < TIMESTAMP '{splits.test_end}' THEN 'test' END AS split FROM inter),
train AS (SELECT * FROM lab WHERE split = 'train'), val AS (SELECT * FROM lab WHERE split = 'val'), test AS (SELECT * FROM lab WHERE split = 'test')"""


__all__ = ["DEEP", "DEEP_EDGES", "INTER", "KEYS", "MAIN", "RAW", "SEGMENTS", "SEGMENT_EDGES", "SPARSE", "by_user", "interactions", "items", "labelled", "pairs", "part_of", "parts", "raw", "segments", "table", "tag_lists"]
