"""Histories of chosen users and texts in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.numbering import number


def histories(inter: DataFrame, users: DataFrame) -> DataFrame:
    """The interactions of the listed users with `position`, 1-based by (ts, item_id) in each user's history.

    users: (user_id), any number, repeated or not. Rows are numbered in one global order dealt by ranges and each user's
    start is taken off, so a user with a third of all rows has no task of its own. Repeated rows get positions of their
    own, in any order among each other; a null ts comes first; null user ids match nothing. Write the result with
    `write_in_order` to have it sorted.
    """
    held = inter.join(users.select("user_id").distinct(), "user_id", "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    placed = number(held, [F.col(c) for c in ("user_id", "ts", "item_id", "__tie")], "__at")
    starts = placed.groupBy("user_id").agg(F.min("__at").alias("__start"))
    return placed.join(starts, "user_id").withColumn("position", F.col("__at") - F.col("__start") + 1).drop("__tie", "__at", "__start")


def in_catalog_order(texts: DataFrame, order: DataFrame, key: str, position: str) -> DataFrame:
    """texts with the position of their key in `order`: one row for each row of order, where the text is null if there is
    none and `found` says which. A key that either side holds twice makes the join ambiguous and raises ValueError."""
    for name, df in (("texts", texts), ("order", order)):
        if not df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"{name}: a {key} stands more than once")
    marked = texts.withColumn("found", F.lit(True))
    return order.select(key, position).join(marked, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
