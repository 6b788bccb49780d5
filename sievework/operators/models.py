"""Recommendation models as DataFrames of (user_id, item_id, score) or (item_id, score)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def popularity(grid: DataFrame, catalog: DataFrame, as_of: str, window: int) -> DataFrame:
    """Item scores at one cell of the grid; items without an interaction have 0."""
    cell = grid.where((F.col("as_of") == F.lit(as_of).cast("timestamp_ntz")) & (F.col("window_days") == window))
    return catalog.select("item_id").join(cell.select("item_id", "n_interactions"), "item_id", "left").select("item_id", F.coalesce("n_interactions", F.lit(0)).cast("double").alias("score"))


def category_shares(train: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each category in a user's train items; items without one are of `__unknown__`."""
    cat = items.select("item_id", F.coalesce("category", F.lit("__unknown__")).alias("category"))
    per = train.join(cat, "item_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).drop("n")


def category_popularity(train: DataFrame, items: DataFrame, pop: DataFrame) -> DataFrame:
    """share(user, category) * popularity, for users with train items (others take popularity itself)."""
    cat = items.select("item_id", F.coalesce("category", F.lit("__unknown__")).alias("category")).join(pop, "item_id")
    return category_shares(train, items).join(cat, "category").where("score > 0").select("user_id", "item_id", (F.col("share") * F.col("score")).alias("score"))


def random_scores(pairs: DataFrame, seed: int) -> DataFrame:
    """A hash of (seed, user, item) in [0, 1): another stream than a generator's, but the same on every run."""
    return pairs.withColumn("score", F.pmod(F.xxhash64(F.lit(seed), "user_id", "item_id"), F.lit(2**53)) / F.lit(float(2**53)))


def item_knn(train: DataFrame, shrink: float = 0.0, top: int = 50, window_days: float | None = None) -> DataFrame:
    """(item_id, neighbour, similarity): co-counts over sqrt(n_i n_j) + shrink, the top neighbours of each item.

    With `window_days` only pairs younger than that (column age_days) co-occur; the limit is open.
    """
    rows = train if window_days is None else train.where(F.col("age_days") < window_days)
    pairs = rows.select("user_id", "item_id").distinct()
    n = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    co = pairs.join(pairs.withColumnRenamed("item_id", "neighbour"), "user_id").where("item_id < neighbour").groupBy("item_id", "neighbour").agg(F.count(F.lit(1)).alias("c"))
    both = co.join(n, "item_id").join(n.select(F.col("item_id").alias("neighbour"), F.col("n").alias("m")), "neighbour")
    half = both.select("item_id", "neighbour", (F.col("c") / (F.sqrt(F.col("n").cast("double") * F.col("m")) + shrink)).alias("similarity"))
    full = half.unionByName(half.select(F.col("neighbour").alias("item_id"), F.col("item_id").alias("neighbour"), "similarity"))
    w = Window.partitionBy("item_id").orderBy(F.col("similarity").desc(), "neighbour")
    return full.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def knn_scores(train: DataFrame, similar: DataFrame) -> DataFrame:
    """Sum of similarities of an item to the user's train items."""
    return train.select("user_id", F.col("item_id").alias("neighbour")).distinct().join(similar, "neighbour").groupBy("user_id", "item_id").agg(F.sum("similarity").alias("score"))


CONFIDENCE = {
    "binary": lambda half_life: F.lit(1.0),
    "rating": lambda half_life: F.col("rating").cast("double"),
    "time_decay": lambda half_life: F.pow(F.lit(2.0), -F.col("age_days") / half_life),
}


def als_identity(params: dict) -> str:
    """Twelve digits of the canonical parameters' sha256; the half-life counts only under time decay."""
    kept = {k: v for k, v in params.items() if k != "half_life" or params.get("confidence") == "time_decay"}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def als(train: DataFrame, rank: int = 16, iterations: int = 5, reg: float = 0.1, alpha: float = 1.0, seed: int = 7, confidence: str = "binary", half_life: float = 365.0):
    """An implicit-feedback factorisation; factors are not bit-stable across partitionings."""
    from pyspark.ml.recommendation import ALS

    rows = train.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), CONFIDENCE[confidence](half_life).cast("float").alias("c"))
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="c", implicitPrefs=True, rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="nan").fit(rows)


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it (Spark has no common subexpressions within lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2(c: Column) -> Column:
    """The unit vector; zeros stay."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])
    return bound(c, lambda v: bound(F.struct(v.alias("v"), norm(v).alias("n")), unit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def profiles(train: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user the unit vector of the mean of their items' unit vectors: (user_id, profile)."""
    unit = vectors.select("item_id", l2(F.transform("vec", lambda x: x.cast("double"))).alias("v"))
    dims = vectors.select(F.max(F.size("vec"))).first()[0]
    if not dims or dims < 1:
        return train.limit(0).select("user_id", F.array().cast("array<double>").alias("profile"))
    means = [F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dims)]  # a row for each user leaves a task, not one for each component
    mean = train.select("user_id", "item_id").join(unit, "item_id").groupBy("user_id").agg(F.max(F.size("v")).alias("n"), *means).where("n > 0")
    return mean.select("user_id", l2(F.slice(F.array(*[f"m{i}" for i in range(dims)]), F.lit(1), F.col("n"))).alias("profile"))


def minmax(c: Column, over: Window) -> Column:
    """To [0, 1] within a group; constants become 0."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)


def blend(content: DataFrame, pop: DataFrame, alpha: float) -> DataFrame:
    """alpha * min-max of content by user + (1 - alpha) * min-max of log(1 + popularity)."""
    log = pop.select("item_id", F.log1p("score").alias("l"))
    ends = F.broadcast(log.agg(F.min("l").alias("low"), F.max("l").alias("high")))  # one row
    p = log.join(ends).select("item_id", F.when(F.col("high") > F.col("low"), (F.col("l") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("p"))
    c = content.select("user_id", "item_id", minmax(F.col("score"), Window.partitionBy("user_id")).alias("c"))
    return c.join(p, "item_id").select("user_id", "item_id", (alpha * F.col("c") + (1 - alpha) * F.col("p")).alias("score"))


def hybrid(low: DataFrame, high: DataFrame, n_train: DataFrame, n_star: int | None) -> DataFrame:
    """The low model for users with fewer than n_star train items, else the high one; None is infinity."""
    if n_star is None:
        return low
    n = n_train.select("user_id", "n_train")
    return low.join(n.where(F.col("n_train") < n_star), "user_id", "left_semi").unionByName(high.join(n.where(F.col("n_train") >= n_star), "user_id", "left_semi"))


REGISTRY = {"popularity": popularity, "category_popularity": category_popularity, "random": random_scores, "item_knn": item_knn, "als": als, "blend": blend, "hybrid": hybrid}
SEEDED = ("random", "als")


def model(name: str, **params):
    """A model's function; a seed is asked of those that draw."""
    if name in SEEDED and "seed" not in params:
        raise ValueError(f"{name} needs a seed")
    return REGISTRY[name]
