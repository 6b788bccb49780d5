"""Exact full-catalog ranks under the mask of seen items, without a users x items matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.numbering import number, numbered_sum
from sievework.sources.scratch import written


#: Rows of a table that may be broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def global_rank(scores: DataFrame) -> DataFrame:
    """item_id, score, rank of a score that is the same for every user: score descending, item ascending."""
    return number(scores, [F.col("score").desc(), F.col("item_id")], "rank")


def masked_ranks(truth: DataFrame, seen: DataFrame, ranked: DataFrame) -> DataFrame:
    """(user_id, item_id, rank) of truth items: the global rank less the seen items before it.

    Per user only their own seen and truth items meet; repeated seen pairs, side by side there, count once.
    """
    r = ranked.select("item_id", "rank")
    gt = truth.select("user_id", "item_id").join(r, "item_id").select("user_id", "item_id", "rank", F.lit(0).alias("seen"))
    mask = seen.select("user_id", "item_id").join(r, "item_id").select("user_id", "item_id", "rank", F.lit(1).alias("seen"))
    w = Window.partitionBy("user_id").orderBy("rank", "seen")
    again = (F.col("seen") == 1) & (F.lag("rank").over(w) == F.col("rank")) & (F.lag("seen").over(w) == 1)
    both = gt.unionByName(mask).withColumn("new", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(F.col("seen")))
    before = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("r", F.col("rank") - F.coalesce(before, F.lit(0)))
    return both.where("seen = 0").select("user_id", "item_id", F.col("r").alias("rank"))


def masked_top(users: DataFrame, seen: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, position <= k): of the global order a user needs the first k + those of them already seen.

    A user's i-th seen item in the order takes a place from the first k unseen ones only if fewer than k unseen items
    come before it; only these seen items meet the slots. No such item and no slot lies beyond the first k + the most
    that any user has seen, so the seen pairs meet this head of the order alone.
    """
    most = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    heads = ranked.select("item_id", "rank").where(F.col("rank") <= k + most)
    heads = F.broadcast(heads) if k + most <= SMALL else heads
    mask = seen.select("user_id", "item_id").join(heads, "item_id").distinct().join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "rank")
    w = Window.partitionBy("user_id").orderBy("rank")
    early = mask.withColumn("i", F.row_number().over(w)).where(F.col("rank") - F.col("i") < k)
    taken = users.select("user_id").distinct().join(early.groupBy("user_id").agg(F.collect_list("rank").alias("taken")), "user_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    slots = F.array_except(F.sequence(F.lit(1).cast("long"), F.size("taken").cast("long") + k), F.col("taken"))
    filled = taken.select("user_id", F.posexplode(slots).alias("position", "rank")).withColumn("position", F.col("position") + 1)
    return filled.join(heads, "rank").select("user_id", "item_id", "position")


def sparse_ranks(truth: DataFrame, seen: DataFrame, scores: DataFrame, index: DataFrame) -> DataFrame:
    """Ranks of truth items for scores that are 0 but for the positive (user_id, item_id, score) given.

    index: (item_id, idx), dense and ascending. Items without a score follow by index.
    """
    mask = seen.select("user_id", "item_id").distinct().withColumn("seen", F.lit(1))
    gt = truth.select("user_id", "item_id").withColumn("gt", F.lit(1))
    rows = scores.select("user_id", "item_id", "score").join(mask, ["user_id", "item_id"], "full").join(gt, ["user_id", "item_id"], "full").join(index, "item_id")
    rows = rows.fillna({"score": 0.0, "seen": 0, "gt": 0}).withColumn("live", ((F.col("score") > 0) & (F.col("seen") == 0)).cast("int"))
    user = Window.partitionBy("user_id")
    above = F.coalesce(F.sum("live").over(user.orderBy(F.col("score").desc(), "idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = ((F.col("score") > 0) | (F.col("seen") == 1)).cast("int")
    below = F.coalesce(F.sum(taken).over(user.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.when(F.col("score") > 0, 1 + above).otherwise(1 + F.sum("live").over(user) + F.col("idx") - below)
    return rows.withColumn("rank", rank.cast("long")).where("gt = 1").select("user_id", "item_id", "rank")


def count_before(items: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with `before`: how many items of the same `group` have a lesser item_id.

    Both are put in one global order that Spark deals by ranges, so a large group has no task of its own. asked has
    group, item_id and other columns; items has group and item_id.
    """
    one = items.select("group", "item_id", F.lit(1).alias("item"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in ("group", "item_id")])
    both = asked.withColumn("item", F.lit(0)).unionByName(one).withColumn("tie", F.monotonically_increasing_id())
    placed = numbered_sum(both, ["group", "item_id", "item", "tie"], "item", "upto")
    first = items.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    last = placed.where("item = 1").groupBy("group").agg(F.max("upto").alias("last")).join(first, "group")
    found = placed.where("item = 0").join(last.select("group", (F.col("last") - F.col("size")).alias("start")), "group", "left")
    return found.withColumn("before", F.coalesce(F.col("upto") - F.col("start"), F.lit(0))).drop("item", "tie", "upto", "start")


def _check_apart(shares: DataFrame, items: DataFrame, digits: int) -> None:
    """No two scores of a category, nor one and 0, may fall together when a share of it multiplies them.

    Gaps are over each category's distinct scores, and one row for each category meets the least shares.
    """
    scores = items.where("score > 0 AND category IS NOT NULL").select("category", "score").distinct()
    gap = F.col("score") - F.lag("score", 1, 0).over(Window.partitionBy("category").orderBy("score"))
    least = scores.withColumn("gap", gap).groupBy("category").agg(F.min("gap").alias("gap"))
    share = shares.where("share > 0").groupBy("category").agg(F.min("share").alias("share"))
    close = least.join(share, "category").where(F.col("gap") * F.col("share") <= 10.0**-digits).select("category", "gap", "share").first()
    if close:
        raise ValueError(f"category {close['category']}: scores {close['gap']} apart fall together at a share of {close['share']} and {digits} digits")


def _reached(share: Column, own: Column, digits: int) -> Column:
    """Of the ascending `levels` the least whose rounded product with a share is above 0 and at least `own`; an array of one, or none.

    Products are compared as they are, less than a unit below; as levels are further apart (`_check_apart`), that leaves
    one that isn't reached at most, and two are rounded. Where doubles are too coarse for that, all are.
    """
    unit = 10.0**-digits
    least = F.array(F.try_divide(F.greatest(own, F.lit(unit)) - 0.75 * unit, share))  # worked out once, not for each level
    below = F.get(F.transform(least, lambda t: F.size(F.filter("levels", lambda x: ~F.coalesce(x["score"] >= t, F.lit(False))))), F.lit(0))
    near = F.when(own < 1e14 * unit, F.slice("levels", below + 1, 2)).otherwise(F.col("levels"))
    product = lambda x: F.round(share * x["score"], digits)
    return F.slice(F.filter(near, lambda x: (product(x) >= own) & (product(x) > 0)), 1, 1)


def shared_ranks(truth: DataFrame, seen: DataFrame, shares: DataFrame, items: DataFrame, digits: int) -> DataFrame:
    """(user_id, item_id, rank) of truth items under the score round(share of the item's category * score, digits).

    shares: (user_id, category, share); items: (item_id, category, score), null categories never match. Users meet
    only the categories they have: a category's items above a score are a running count over its distinct scores
    (whole counts of interactions, whose distinct values grow with the square root of their sum), ties are counted by
    `count_before`, once for each item and score, and a user's own seen items are taken off. Items without a score
    follow by id. Truth pairs and item ids are unique. Scores of one
    category must differ after rounding, and be above 0: where the least gap of a category times the least share in it
    could round away, ValueError is raised, as ranks would be wrong.
    """
    _check_apart(shares, items, digits)
    scored = F.round(F.col("share") * F.col("score"), digits)
    indexed = number(items.select("item_id", "category", "score"), [F.col("item_id")], "idx")
    of = truth.select("user_id", "item_id").join(indexed, "item_id").join(shares, ["user_id", "category"], "left")
    asked = written(of.select("user_id", "item_id", "idx", F.coalesce(scored, F.lit(0.0)).alias("own")), "asked")
    levels = items.where("score > 0").groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("category").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    table = levels.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("score", "above", "n"))).alias("levels"))
    met = asked.join(shares.select("user_id", "category", "share"), "user_id").join(table, "category")
    met = met.select("user_id", "item_id", "category", "share", "own", F.explode(_reached(F.col("share"), F.col("own"), digits)).alias("level"))
    equal = F.round(F.col("share") * F.col("level.score"), digits) == F.col("own")
    met = met.withColumns({"tied": equal, "more": F.col("level.above") + F.when(equal, F.lit(0)).otherwise(F.col("level.n"))})
    met = written(met.select("user_id", "item_id", "category", F.col("level.score").alias("score"), "tied", "more"), "met")
    none = F.lit(0).cast(items.schema["score"].dataType)  # no positive score
    group = lambda score: F.struct(F.col("category").alias("category"), score.alias("score")).alias("group")
    ties = met.where("tied").select(group(F.col("score")), "user_id", "item_id", F.lit(1).alias("sign"))
    zero = asked.where("own = 0").join(shares.select("user_id", "category"), "user_id").select(group(none), "user_id", "item_id", F.lit(-1).alias("sign"))
    met_groups = ties.unionByName(zero)
    positive = items.where("score > 0")
    # how many of a group come before an item is the same for all users, so each item is counted once in each group
    counted = count_before(positive.select(group(F.col("score")), "item_id").unionByName(positive.select(group(none), "item_id")), met_groups.select("group", "item_id").distinct())
    tied = met_groups.join(counted, ["group", "item_id"]).select("user_id", "item_id", (F.col("before") * F.col("sign")).alias("n"))
    mask = seen.select("user_id", "item_id").distinct().join(items.select("item_id", "category", "score"), "item_id").join(shares, ["user_id", "category"], "left")
    mask = mask.select("user_id", "item_id", F.lit(0).cast("long").alias("idx"), F.coalesce(scored, F.lit(0.0)).alias("own"), F.lit(1).alias("seen"))
    both = asked.withColumn("seen", F.lit(0)).unionByName(mask)
    off = F.sum("seen").over(Window.partitionBy("user_id").orderBy(F.col("own").desc(), "item_id", "seen").rowsBetween(Window.unboundedPreceding, -1))
    base = F.when(F.col("own") == 0, F.col("idx")).otherwise(1) - F.coalesce(off, F.lit(0))
    rows = both.withColumn("n", base).where("seen = 0").select("user_id", "item_id", "n").unionByName(met.select("user_id", "item_id", F.col("more").alias("n"))).unionByName(tied)
    return rows.groupBy("user_id", "item_id").agg(F.sum("n").cast("long").alias("rank"))
