"""Breakdowns by history depth and item regime, churn, and routing grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.times import first_seen_bucket, recency_bucket, support_bucket


def support(truth: DataFrame, train: DataFrame) -> DataFrame:
    """Truth rows with their item's train support and its bucket."""
    n = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_train"))
    out = truth.join(n, "item_id", "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    return out.withColumn("regime", support_bucket(F.col("n_train")))


def bucket_shares(rows: DataFrame, bucket: str) -> DataFrame:
    """rows and share of each bucket; over an empty input there is nothing to share."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select(bucket, "n", (F.col("n") / F.col("total")).alias("share"))


def churn_share(truth: DataFrame, train: DataFrame) -> DataFrame:
    """Share of truth on items with at most 4 train interactions; empty inputs raise."""
    if truth.isEmpty() or train.isEmpty():
        raise ValueError("a churn share of nothing")
    rows = support(truth.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows")), train)  # a row for each item meets the counts
    return rows.agg(F.sum("rows").alias("n"), (F.sum(F.when(F.col("n_train") <= 4, F.col("rows")).otherwise(0)) / F.sum("rows")).alias("share"))


def gate_verdict(share: Column) -> Column:
    return F.when(share < 0.10, "wrong").when(share < 0.25, "partial").otherwise("supported")


def recall_ceiling(truth: DataFrame, train: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of truth on items with support of at least 1 and 5: all, by segment and by deep bucket."""
    rows = support(truth, train).join(segments.select("user_id", "segment", "deep"), "user_id")
    return rows.groupingSets([["segment"], ["deep"], []], "segment", "deep").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_train") >= 1).cast("double")).alias("at_least_1"), F.avg((F.col("n_train") >= 5).cast("double")).alias("at_least_5"))


def regime_cells(ranks: DataFrame, regimes: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment and regime: users, truth rows, mean recall@10 of the truth in that regime."""
    per = ranks.join(regimes.select("item_id", "regime").distinct(), "item_id").groupBy("user_id", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= 10).cast("double")).alias("recall"))
    return per.join(segments.select("user_id", "segment"), "user_id").groupBy("segment", "regime").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("n"), F.avg("recall").alias("recall_10"))


AXES = ("support", "recency", "first_seen")


def item_axes(catalog: DataFrame, train: DataFrame, inter: DataFrame, train_end: str, oldest: int) -> DataFrame:
    """(item_id, support, recency, first_seen): the bucket of every catalog item on each axis."""
    of_train = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    first = inter.groupBy("item_id").agg(F.min("ts").alias("first"))
    rows = catalog.select("item_id").distinct().join(of_train, "item_id", "left").join(first, "item_id", "left")
    return rows.select("item_id", support_bucket(F.coalesce("n", F.lit(0))).alias("support"), recency_bucket(F.col("last"), train_end).alias("recency"), first_seen_bucket(F.col("first"), train_end, oldest).alias("first_seen"))


def axis_shares(truth: DataFrame, axes: DataFrame) -> DataFrame:
    """(axis, bucket, gt, gt_items, items and the share of each): where truth, distinct truth items and the catalog lie."""
    n = truth.groupBy("item_id").agg(F.count(F.lit(1)).alias("gt"))
    rows = axes.join(n, "item_id", "left").fillna(0, ["gt"]).unpivot(["item_id", "gt"], list(AXES), "axis", "bucket")
    per = rows.groupBy("axis", "bucket").agg(F.sum("gt").alias("gt"), F.count_if(F.col("gt") > 0).alias("gt_items"), F.count(F.lit(1)).alias("items"))
    whole = Window.partitionBy("axis")  # a few buckets
    return per.withColumns({f"{c}_share": F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0)) for c in ("gt", "gt_items", "items")})


def restricted(ranks: DataFrame, axes: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, axis, bucket, gt, hits, gain, recall, ndcg): accuracy on the truth of each bucket alone.

    ranks may have further columns (such as an arm) that stay keys. The ideal order is that of the bucket's own truth.
    """
    keys = [c for c in ranks.columns if c not in ("item_id", "rank")]
    rows = ranks.join(axes, "item_id").unpivot([*keys, "rank"], list(AXES), "axis", "bucket")
    hit = F.col("rank") <= k
    per = rows.groupBy(*keys, "axis", "bucket").agg(F.count(F.lit(1)).alias("gt"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gt", F.lit(k)).cast("int")), F.lit(0.0), lambda a, j: a + 1 / F.log2(j + 1))
    return per.withColumns({"recall": F.col("hits") / F.col("gt"), "ndcg": F.col("gain") / ideal})


def recomposition(parts: DataFrame, ranks: DataFrame, k: int = 10, tolerance: float = 1e-12) -> DataFrame:
    """(keys, axis, measure, parts, whole) where an axis' buckets don't add up to the unrestricted measure; none may.

    gt and hits must agree exactly, recall (weighted by gt) and the discounted gain within the tolerance. A user whose
    truth is missing on an axis shows as null.
    """
    keys = [c for c in ranks.columns if c not in ("item_id", "rank")]
    names = ("gt", "hits", "gain", "recall")
    hit = F.col("rank") <= k
    whole = ranks.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("gt"), F.count_if(hit).cast("double").alias("hits"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"), F.avg(hit.cast("double")).alias("recall"))
    whole = whole.unpivot(keys, list(names), "measure", "whole").withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    sums = parts.groupBy(*keys, "axis").agg(F.sum("gt").cast("double").alias("gt"), F.sum("hits").cast("double").alias("hits"), F.sum("gain").alias("gain"), (F.sum(F.col("recall") * F.col("gt")) / F.sum("gt")).alias("recall"))
    met = whole.join(sums.unpivot([*keys, "axis"], list(names), "measure", "parts"), [*keys, "axis", "measure"], "full")
    return met.where(F.coalesce(F.abs(F.col("parts") - F.col("whole")) > tolerance, F.lit(True)))


def routing_grid(low: DataFrame, high: DataFrame, n_train: DataFrame, metric: str, grid: list[int]) -> DataFrame:
    """Mean metric when users under each threshold take the low arm: threshold, objective."""
    both = low.select("user_id", F.col(metric).alias("x")).join(high.select("user_id", F.col(metric).alias("y")), "user_id").join(n_train.select("user_id", "n_train"), "user_id")
    cells = both.withColumn("threshold", F.explode(F.array(*[F.lit(g) for g in grid])))
    return cells.groupBy("threshold").agg(F.avg(F.when(F.col("n_train") < F.col("threshold"), F.col("x")).otherwise(F.col("y"))).alias("objective"))


def best_cell(grid: DataFrame) -> DataFrame:
    """The greatest objective, of ties the largest threshold."""
    return grid.orderBy(F.col("objective").desc(), F.col("threshold").desc()).limit(1)


def curate(users: DataFrame, hits: int, misses: int, seed: int) -> DataFrame:
    """Per segment so many hit and missed users by a seeded hash: user_id, segment, hit."""
    w = Window.partitionBy("segment", "hit").orderBy(F.xxhash64(F.lit(seed), "user_id"), "user_id")
    return users.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.when(F.col("hit"), hits).otherwise(misses)).drop("r")
