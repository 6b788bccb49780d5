"""Accuracy per user from ranks, and what a set of recommendations is like beyond accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.numbering import number
from sievework.operators.ranking import small
from sievework.sources.scratch import written


def per_user(ranks: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """recall@10/20, hitrate@10, mrr, ndcg@10/20 of each user; users without truth get 0."""
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.count(F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda a, j: a + 1 / F.log2(j + 1))
    within = lambda k: F.count_if(F.col("rank") <= k)
    out = ranks.groupBy("user_id").agg(
        *[(within(k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in (10, 20)], (within(10) > 0).cast("double").alias("hit_10"),
        (1 / F.min("rank")).alias("mrr"), *[(gain(k) / ideal(k)).alias(f"ndcg_{k}") for k in (10, 20)],
    )
    return out if users is None else users.select("user_id").join(out, "user_id", "left").fillna(0.0)


METRICS = ("recall_10", "recall_20", "hit_10", "mrr", "ndcg_10", "ndcg_20")


def means(metrics: DataFrame, segment: str | None = None) -> DataFrame:
    """Means over all users and, with GROUPING SETS, by segment."""
    aggs = [F.avg(m).alias(m) for m in METRICS] + [F.count(F.lit(1)).alias("users")]
    if segment is None:
        return metrics.agg(*aggs)
    return metrics.groupingSets([[segment], []], segment).agg(*aggs)


def coverage(top: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    used = top.where(F.col("position") <= k).agg(F.count_distinct("item_id").alias("used"))
    return used.join(catalog.agg(F.count(F.lit(1)).alias("items"))).select((F.col("used") / F.col("items")).alias("coverage"))


def novelty(top: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """Per user the mean surprisal -log2((c + 1) / (sum c + items)); counts: (item_id, n) of the whole catalog."""
    total = counts.agg((F.sum("n") + F.count(F.lit(1))).alias("mass"))
    surprise = counts.join(F.broadcast(total)).select("item_id", (-F.log2((F.col("n") + 1) / F.col("mass"))).alias("s"))
    kept = top.where(F.col("position") <= k)
    used = written(surprise.join(kept.select("item_id").distinct(), "item_id", "left_semi"), "surprise")
    return kept.join(small(used), "item_id").groupBy("user_id").agg(F.avg("s").alias("novelty"))


def head_share(top: DataFrame, counts: DataFrame, k: int = 10, share: float = 0.01) -> DataFrame:
    """Share of the slots that go to the ceil(share * items) most popular items."""
    ranked = number(counts, [F.col("n").desc(), F.col("item_id")], "r").join(F.broadcast(counts.agg(F.ceil(F.count(F.lit(1)) * share).alias("head"))))
    head = ranked.where("r <= head").select("item_id", F.lit(1).alias("in_head"))
    slots = top.where(F.col("position") <= k).groupBy("item_id").agg(F.count(F.lit(1)).alias("slots"))
    return slots.join(head, "item_id", "left").agg((F.sum(F.col("slots") * F.coalesce("in_head", F.lit(0))) / F.sum("slots")).alias("head_share"))


def gini(counts: DataFrame) -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending counts.

    The rank is summed by count, of which there are few, so no task sorts all items.
    """
    per = counts.groupBy("n").agg(F.count(F.lit(1)).alias("items"))
    before = F.coalesce(F.sum("items").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("ranks", F.col("items") * before + F.col("items") * (F.col("items") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("n") * F.col("ranks")).alias("w"), F.sum(F.col("n") * F.col("items")).alias("x"), F.sum("items").alias("k"))
    return sums.select((2 * F.col("w") / (F.col("k") * F.col("x")) - (F.col("k") + 1) / F.col("k")).alias("gini"))
