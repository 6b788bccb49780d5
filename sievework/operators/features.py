"""User, item and text features of interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import normal_tag
from sievework.functions.times import Splits, in_window
from sievework.operators.numbering import number
from sievework.sources.scratch import written


def user_stats(inter: DataFrame, splits: Splits) -> DataFrame:
    label = splits.label(F.col("ts"))
    return inter.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(label == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.datediff(F.max("ts"), F.min("ts")).alias("tenure_days"),
    )


def popularity_grid(inter: DataFrame, as_ofs: list[str], windows: list[int]) -> DataFrame:
    """Interactions and distinct users per (as_of, window_days, item): one scan, a count for each cell.

    A user's interactions with an item become one row with a count for each cell, so no row is made for a row and a cell
    before an item's counts are added up; users without a name count as interactions only.
    """
    cells = [(F.lit(a).cast("timestamp_ntz"), w) for a in as_ofs for w in windows]
    per = inter.groupBy("user_id", "item_id").agg(*[F.count_if(in_window(F.col("ts"), a, F.lit(w))).alias(f"n{i}") for i, (a, w) in enumerate(cells)])
    sums = [x for i in range(len(cells)) for x in (F.sum(f"n{i}").alias(f"n{i}"), F.count_if((F.col(f"n{i}") > 0) & F.col("user_id").isNotNull()).alias(f"u{i}"))]
    rows = F.array(*[F.struct(a.alias("as_of"), F.lit(w).alias("window_days"), F.col(f"n{i}").alias("n_interactions"), F.col(f"u{i}").alias("n_unique_users")) for i, (a, w) in enumerate(cells)])
    return per.groupBy("item_id").agg(*sums).select("item_id", F.explode(rows).alias("c")).where("c.n_interactions > 0").select("c.as_of", "c.window_days", "item_id", "c.n_interactions", "c.n_unique_users")


def item_train_stats(inter: DataFrame, splits: Splits) -> DataFrame:
    train = splits.label(F.col("ts")) == "train"
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return inter.groupBy("item_id").agg(F.count_if(train).alias("n_train_support"), millis(F.max(F.when(train, F.col("ts")))).alias("last_train_ms"), millis(F.min("ts")).alias("first_seen_ms"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with both endpoints' degrees."""
    users = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_degree"))
    items = edges.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_degree"))
    return edges.join(users, "user_id").join(items, "item_id")


def top_tags(tags: DataFrame, k: int = 10) -> DataFrame:
    """Per item its k heaviest tags (distinct users; ties by tag) as an ordered list."""
    return _heaviest(_tag_weights(tags), k)


def _tag_weights(tags: DataFrame) -> DataFrame:
    clean = tags.select("item_id", "user_id", normal_tag(F.col("tag")).alias("tag")).where("tag is not null")
    return clean.groupBy("item_id", "tag").agg(F.count_distinct("user_id").alias("weight"))


def _heaviest(weight: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("weight").desc(), "tag"))
    top = weight.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))


def top_listed_tags(lists: DataFrame, k: int = 10) -> DataFrame:
    """`top_tags` of rows (item_id, user_id, tags: one string, parted by spaces).

    Where a user has one row of an item, its tags are made distinct in the row and counted where they stand, so that
    what leaves a task is a row for each tag and not for each user and tag. Users of several rows are counted apart.
    """
    again = written(lists.where("user_id is not null").groupBy("item_id", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("item_id").alias("i"), F.col("user_id").alias("u")), "repeated")
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("user_id") == F.col("u"))
    once = lists.join(again, same, "left_anti")
    row = once.select("item_id", F.col("user_id").isNotNull().cast("long").alias("n"), F.explode(F.array_distinct(F.split(F.lower("tags"), " "))).alias("tag"))
    weight = row.withColumn("tag", normal_tag(F.col("tag"))).where("tag is not null").groupBy("item_id", "tag").agg(F.sum("n").alias("weight"))
    if not again.isEmpty():
        several = lists.join(again, same, "left_semi").select("item_id", "user_id", F.explode(F.split("tags", " ")).alias("tag"))
        weight = weight.unionByName(_tag_weights(several)).groupBy("item_id", "tag").agg(F.sum("weight").alias("weight"))
    return _heaviest(weight, k)


def text_coverage(items: DataFrame, tags: DataFrame, cutoff: str, recipe: Column) -> DataFrame:
    """How much text a catalog has before anything is embedded: measure, n, rows, share (0 where rows is 0).

    items: (item_id unique, genres array); tags: (item_id, tag, ts), those up to `cutoff` count. `zero_tag`: items
    without a usable tag; `empty_genres`; `empty_text`: items whose recipe is null or empty and that have no tag either;
    `empty_tag_rows`: tag rows in the window that are null or blank once normalised, of all in the window. A null
    genres array is empty, tags of unknown items count as rows only.
    """
    inside = tags.where(F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz")).select("item_id", normal_tag(F.col("tag")).alias("tag"))
    per = inside.groupBy("item_id").agg(F.count(F.lit(1)).alias("tag_rows"), F.count("tag").alias("tags"))
    marked = items.withColumn("__text", F.coalesce(recipe, F.lit(""))).join(per, "item_id", "full_outer")
    item, bare = F.col("__text").isNotNull(), F.coalesce("tags", F.lit(0)) == 0
    n = {
        "zero_tag": F.count_if(item & bare),
        "empty_genres": F.count_if(item & (F.coalesce(F.size("genres"), F.lit(0)) <= 0)),
        "empty_text": F.count_if(item & bare & (F.trim("__text") == "")),
        "empty_tag_rows": F.coalesce(F.sum(F.col("tag_rows") - F.col("tags")), F.lit(0)),
    }
    wide = marked.agg(*[c.alias(k) for k, c in n.items()], F.count_if(item).alias("__items"), F.coalesce(F.sum("tag_rows"), F.lit(0)).alias("__tags"))
    long_ = wide.unpivot(["__items", "__tags"], list(n), "measure", "n")
    rows = F.when(F.col("measure") == "empty_tag_rows", F.col("__tags")).otherwise(F.col("__items"))
    return long_.select("measure", "n", rows.alias("rows"), F.coalesce(F.try_divide("n", rows), F.lit(0.0)).alias("share"))


def volume(inter: DataFrame, unit: str = "month") -> DataFrame:
    """Interactions and distinct users per period, with the running count and its share of all.

    The running sum is over one row for each period.
    """
    per = inter.groupBy(F.date_trunc(unit, "ts").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("running", F.sum("n").over(upto)).withColumn("share", F.col("running") / F.sum("n").over(Window.partitionBy()))


def day_slices(inter: DataFrame) -> DataFrame:
    return inter.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def dense_index(ids: DataFrame, column: str, name: str) -> DataFrame:
    """0-based index by ascending id."""
    return number(ids.select(column).distinct(), [F.col(column)], name).withColumn(name, (F.col(name) - 1).cast("int"))


def category_codes(items: DataFrame) -> DataFrame:
    """Codes of categories in the order in which they first appear over sorted items; null is 0."""
    first = items.where("category is not null").groupBy("category").agg(F.min("item_id").alias("first"))
    return first.select("category", F.row_number().over(Window.orderBy("first")).alias("code"))
