"""Exact full-catalog ranks, top lists and score ranges of factor models: user vectors times item vectors, by blocks.

A score is the rounded product of a user's and an item's vector. Ties go to the lower item_id. A vector of zeros scores 0
everywhere. Only what has a score of its own is multiplied:

* Items with one and the same vector (those without any, those that differ by their popularity only) are a class from BIG
  of them on, and a class is one column of the product. Members before an item in its own class are its place there; the
  rare ties with other classes are counted by `count_before`.
* Users whose vector is zeros take the items by id.
* Seen items are not masked in the product: a user's own seen and truth items meet in one running count, before it.

What is left is dealt over blocks of users and items; each pair of blocks is one task. What leaves it is the number of its
items above each truth score, a user's k best, and the block's least and greatest score. Each user and each truth pair
travels once for every block of columns, each column once for every block of users, so the traffic grows with the product of
both over the size of a block, which is bounded by memory alone; the work itself is users x columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.models import dot
from sievework.operators.numbering import number
from sievework.operators.ranking import count_before, masked_top
from sievework.sources.scratch import written

#: A block holds at most USERS users and NUMBERS components on either side; a tile is TILE users by WIDE columns.
USERS, NUMBERS, TILE, WIDE, DIGITS = 65_536, 1 << 24, 256, 16_384, 9
#: A pair lies in memory beside its user like so many components.
PAIR = 16
#: From this number of truth items of a user on, a row of scores is sorted once instead of being compared with each.
MANY = 12
#: Equal vectors from this number on are a class; a broadcast of classes is at most this part of the catalog.
BIG = 256
#: Pairs of blocks that a small product is cut into, so that it has tasks for all cores.
LEAST = 24

_FOUND = "kind int, user_id long, item_id long, score double, high double, n long"
USER, ITEM, SEEN, TRUTH, CLASS = range(5)
RANGE, TOP, ABOVE, TIE = range(4)
_EMPTY = pa.schema([("kind", pa.int32()), ("user_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])


def filled(ids: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, vec) of all ids; those without a vector get zeros."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return ids.select(key).distinct().join(vectors.select(key, F.transform("vec", lambda x: x.cast("double")).alias("vec")), key, "left").select(key, F.coalesce("vec", zeros).alias("vec"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _block(rows: pa.Table) -> tuple[dict[int, pa.Table], Callable[[int, str], np.ndarray]]:
    kinds = rows["kind"].to_numpy()
    part = {kind: rows.filter(pa.array(kinds == kind)) for kind in range(5)}
    return part, lambda kind, name: part[kind][name].to_numpy()


def _found(out: list[list[np.ndarray]]) -> pa.Table:
    if not out:
        return _EMPTY.empty_table()
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _EMPTY, strict=True)], schema=_EMPTY)


def _counts(rows: pa.Table) -> pa.Table:
    """Of one block: ranges of users, items above each truth score, and classes tied with one.

    Scores are whole numbers of 10 ** -DIGITS. An item's score and its column make one number that orders both, so one
    comparison counts the items before a truth item; where it would pass 53 bits, two do.
    """
    part, ids = _block(rows)
    if not len(part[USER]):
        return _EMPTY.empty_table()
    user_order, item_order = np.argsort(ids(USER, "user_id")), np.argsort(ids(ITEM, "item_id"))
    users, items = ids(USER, "user_id")[user_order], ids(ITEM, "item_id")[item_order]
    u = _matrix(part[USER]["vec"])[user_order] * 10.0**DIGITS
    v = _matrix(part[ITEM]["vec"])[item_order] if len(items) else np.zeros((0, u.shape[1]))
    classes, sizes = ids(CLASS, "item_id"), ids(CLASS, "n")
    cv = _matrix(part[CLASS]["vec"]) if len(classes) else np.zeros((0, u.shape[1]))
    row = np.searchsorted(users, ids(TRUTH, "user_id"))
    order = np.argsort(row, kind="stable")
    row, truth, score, own_class = row[order], ids(TRUTH, "item_id")[order], ids(TRUTH, "score")[order], ids(TRUTH, "n")[order]
    own = np.rint(score * 10.0**DIGITS)
    place = np.searchsorted(items, truth)  # of the truth item among the columns, whether it is one of them or not
    here = np.zeros(len(truth), bool)
    here[place < len(items)] = items[place[place < len(items)]] == truth[place < len(items)]
    shift = float(1 << max(1, len(items)).bit_length())
    # what a rank has before any column is counted comes with one of the blocks
    above = part[TRUTH]["base"].fill_null(0).to_numpy().astype(np.int64)[order] if "base" in rows.column_names else np.zeros(len(truth), np.int64)
    out: list[list[np.ndarray]] = []
    for s in range(0, len(users), TILE):
        tile = u[s : s + TILE]
        low, high = np.full(len(tile), np.inf), np.full(len(tile), -np.inf)
        a, b = np.searchsorted(row, [s, s + TILE])
        if len(classes):
            level = np.rint(tile @ cv.T)
            low, high = np.minimum(low, level.min(1)), np.maximum(high, level.max(1))
            for t in range(a, b, TILE):
                some = slice(t, min(b, t + TILE))
                scores, other = level[row[some] - s], classes[None] != own_class[some][:, None]
                above[some] += ((scores > own[some][:, None]) & other) @ sizes
                pair, tied = np.nonzero((scores == own[some][:, None]) & other)
                out.append([np.full(len(pair), TIE), users[row[some][pair]], truth[some][pair], score[some][pair], score[some][pair], classes[tied]])
        for c in range(0, len(items), WIDE):
            level = np.rint(tile @ v[c : c + WIDE].T)
            width = level.shape[1]
            least, most = level.min(1), level.max(1)
            low, high = np.minimum(low, least), np.maximum(high, most)
            inside = np.flatnonzero(here[a:b] & (place[a:b] >= c) & (place[a:b] < c + width)) + a
            above[inside] -= level[row[inside] - s, place[inside] - c] > own[inside]  # an item isn't above itself
            packed = max(-least.min(), most.max(), np.abs(own[a:b]).max(initial=0)) * shift < 2.0**52
            if packed:
                level *= shift
                level -= np.arange(c, c + width)
                key = own[a:b] * shift - place[a:b]
                ends = np.searchsorted(row[a:b], np.arange(s, s + len(tile) + 1))
                for r in range(len(tile)):
                    first, last = ends[r], ends[r + 1]
                    if last - first < MANY:
                        for t in range(first, last):
                            above[a + t] += np.count_nonzero(level[r] > key[t])
                    else:
                        level[r].sort()
                        above[a + first : a + last] += width - np.searchsorted(level[r], key[first:last], side="right")
            else:
                for t in range(a, b):
                    scores = level[row[t] - s]
                    above[t] += np.count_nonzero(scores > own[t]) + np.count_nonzero(scores[: max(0, place[t] - c)] == own[t])
        none = np.zeros(len(tile), np.int64)
        if len(items) or len(classes):
            out.append([np.full(len(tile), RANGE), users[s : s + TILE], none, low / 10.0**DIGITS + 0.0, high / 10.0**DIGITS + 0.0, none])
    none = np.zeros(len(truth))
    out.append([np.full(len(truth), ABOVE), users[row], truth, none, none, above])
    return _found(out)


def _best(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block: the k best items of each user, without the seen ones."""

    def run(rows: pa.Table) -> pa.Table:
        part, ids = _block(rows)
        if not len(part[USER]) or not len(part[ITEM]):
            return _EMPTY.empty_table()
        user_order, item_order = np.argsort(ids(USER, "user_id")), np.argsort(ids(ITEM, "item_id"))
        users, items = ids(USER, "user_id")[user_order], ids(ITEM, "item_id")[item_order]
        u, v = _matrix(part[USER]["vec"])[user_order], _matrix(part[ITEM]["vec"])[item_order]
        seen_row, seen_column = np.searchsorted(users, ids(SEEN, "user_id")), np.searchsorted(items, ids(SEEN, "item_id"))
        order = np.argsort(seen_row, kind="stable")
        seen_row, seen_column = seen_row[order], seen_column[order]
        out: list[list[np.ndarray]] = []
        for s in range(0, len(users), TILE):
            a, b = np.searchsorted(seen_row, [s, s + TILE])
            mask_row, mask_column, here, best = seen_row[a:b] - s, seen_column[a:b], users[s : s + TILE], []
            least = np.full(len(here), -np.inf)  # k columns of those so far score as much, but for rounding
            for c in range(0, len(items), WIDE):
                score = u[s : s + TILE] @ v[c : c + WIDE].T
                width = score.shape[1]
                inside = (mask_column >= c) & (mask_column < c + width)
                score[mask_row[inside], mask_column[inside] - c] = -np.inf
                open_ = np.flatnonzero(least == -np.inf)
                if width > k and len(open_):
                    least[open_] = np.partition(score[open_], width - k, axis=1)[:, width - k] - 10.0 ** (1 - DIGITS)
                row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                best.append((row, column + c, np.round(score[row, column], DIGITS) + 0.0))
            row, column, value = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((column, -value, row))
            row, column, value = row[order], column[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, column, value = row[place < k], column[place < k], value[place < k]
            out.append([np.full(len(row), TOP), here[row], items[column], value, value, np.zeros(len(row), np.int64)])
        return _found(out)

    return run


class Ranked:
    """What `product` gives; each of it is worked out when it is asked for."""

    def __init__(self, users: DataFrame, items: DataFrame, truth: DataFrame, seen: DataFrame, k: int, user_block: int | None, item_block: int | None, big: int):
        self._k, self._user_block, self._item_block, self._big = k, user_block, item_block, big
        self._users, self._items, self._truth, self._seen = users, items, truth, seen

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """users (user_id, vec, cold), items (item_id, cls, place, idx, vec), classes (cls, vec, n).

        cls is the least item_id of a class, place the item's number in it, idx its number in the catalog. Members of a
        class have no vec of their own.
        """
        zero = F.forall("vec", lambda x: x == 0)
        users = written(self._users.select("user_id", "vec", zero.alias("cold")), "users")
        plain = written(self._items.select("item_id", F.transform("vec", lambda x: x + 0.0).alias("vec")), "items")
        classes = written(plain.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("cls")).where(F.col("n") >= self._big), "classes")
        named = plain.join(F.broadcast(classes.select("vec", "cls")), "vec", "left")
        indexed = written(number(named.select("item_id", "cls"), [F.col("item_id")], "idx"), "indexed")
        placed = number(indexed.where("cls is not null"), [F.col("cls"), F.col("item_id")], "at")
        starts = placed.groupBy("cls").agg(F.min("at").alias("start"))
        placed = placed.join(F.broadcast(starts), "cls").select("item_id", (F.col("at") - F.col("start") + 1).alias("place"))
        own = named.where("cls is null").select("item_id", "vec")
        items = indexed.join(placed, "item_id", "left").join(own, "item_id", "left")
        return users, written(items.select("item_id", "cls", "place", "idx", "vec"), "sided"), classes

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """(user_id, item_id, seen, cold, cls, place, idx, score) of the pairs (user_id, item_id, seen) whose user and item are given.

        They are dealt by item, where each is taken once and meets its item, and then by user, where they stay.
        """
        users, items, classes = self._sides
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = pairs.select("user_id", "item_id", "seen").repartition(parts, "item_id").distinct().join(items, "item_id").join(users.withColumnRenamed("vec", "u"), "user_id")
        met = met.join(F.broadcast(classes.select("cls", F.col("vec").alias("shared"))), "cls", "left")
        score = F.when(F.col("cold"), 0.0).otherwise(F.round(dot(F.col("u"), F.coalesce("vec", "shared")), DIGITS) + 0.0)
        return met.select("user_id", "item_id", "seen", "cold", "cls", "place", "idx", score.alias("score"))

    def _laid(self, users: DataFrame, columns: list[tuple[DataFrame, int]], pairs: list[tuple[DataFrame, int]], name: str, kernel) -> DataFrame:
        """users, columns (item_id, vec, n) and pairs (user_id, item_id, score, n) by pairs of blocks, through the kernel."""
        n, dims = users.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        m, dims = sum(df.count() for df, _ in columns), max(1, dims or 1)
        ib = self._item_blocks = max(1, -(-m // (self._item_block or max(1, NUMBERS // dims))))
        own_pairs = sum(df.count() for df, _ in pairs) / max(1, n)  # they lie in memory beside their user
        room = max(1, int(NUMBERS // (2 * dims + PAIR * own_pairs)))
        size = self._user_block or min(USERS, room, max(TILE, -(-n * ib // LEAST)))
        ub = max(1, -(-n // size))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        none = {"user_id": "long", "item_id": "long", "vec": "array<double>", "score": "double", "n": "long", "base": "long"}

        def laid(df: DataFrame, kind: int, u: Column, i: Column) -> DataFrame:
            return df.select(u.alias("ub"), i.alias("ib"), F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

        rows = laid(users, USER, own("user_id", ub), every(ib))
        for df, kind in columns:
            rows = rows.unionByName(laid(df, kind, every(ub), own("item_id", ib)))
        for df, kind in pairs:
            rows = rows.unionByName(laid(df, kind, own("user_id", ub), own("item_id", ib) if kind == SEEN else every(ib)))
        rows = rows.withColumn("base", F.when(F.col("ib") == 0, F.col("base")))
        return written(rows.groupBy("ub", "ib").applyInArrow(kernel, _FOUND), name)

    @cached_property
    def _of_truth(self) -> DataFrame:
        """(user_id, item_id, cold, cls, score, base) of the truth pairs. base: their rank before columns are counted, without the seen items before them."""
        pairs = self._scored(self._truth.select("user_id", "item_id", F.lit(0).alias("seen")).unionByName(self._seen.select("user_id", "item_id", F.lit(1).alias("seen"))))
        before = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id", "seen").rowsBetween(Window.unboundedPreceding, -1)
        off = F.coalesce(F.sum("seen").over(before), F.lit(0))
        base = F.when(F.col("cold"), F.col("idx")).otherwise(F.coalesce("place", F.lit(1))) - off
        return written(pairs.withColumn("base", base.cast("long")).where("seen = 0").select("user_id", "item_id", "cold", "cls", "score", "base"), "scored")

    @cached_property
    def _counted(self) -> DataFrame:
        users, items, classes = self._sides
        columns = [(items.where("cls is null").select("item_id", "vec"), ITEM), (classes.select(F.col("cls").alias("item_id"), "vec", "n"), CLASS)]
        asked = self._of_truth.where("not cold").select("user_id", "item_id", "score", F.coalesce("cls", F.lit(-1)).alias("n"), "base")
        return self._laid(users.where("not cold"), columns, [(asked, TRUTH)], "products", _counts)

    @cached_property
    def ranks(self) -> DataFrame:
        """user_id, item_id, rank of each truth pair. Blocks that hold all columns give ranks; counts of several are added up."""
        _, items, _ = self._sides
        cold = self._of_truth.where("cold").select("user_id", "item_id", F.col("base").alias("rank"))
        rows = self._counted.where(F.col("kind") == ABOVE).select("user_id", "item_id", F.col("n").alias("rank"))
        ties = self._counted.where(F.col("kind") == TIE).select(F.col("n").alias("group"), "user_id", "item_id")
        tied = bool(ties.limit(1).count())
        if tied:
            members = items.where("cls is not null").select(F.col("cls").alias("group"), "item_id")
            rows = rows.unionByName(count_before(members, ties).select("user_id", "item_id", F.col("before").alias("rank")))
        if tied or self._item_blocks > 1:
            rows = rows.groupBy("user_id", "item_id").agg(F.sum("rank").cast("long").alias("rank"))
        return rows.unionByName(cold)

    @cached_property
    def ranges(self) -> DataFrame:
        """user_id, low, high over the whole catalog, seen items too."""
        users, items, _ = self._sides
        warm = self._counted.where(F.col("kind") == RANGE).groupBy("user_id").agg(F.min("score").alias("low"), F.max("high").alias("high"))
        some = items.limit(1).select("item_id")  # without items there are no ranges
        cold = users.where("cold").join(F.broadcast(some)).select("user_id", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
        return warm.unionByName(cold)

    @cached_property
    def top(self) -> DataFrame:
        """user_id, item_id, score, position up to k.

        Of a class a user can take the first k + seen members at most, so later ones than the most seen of any user leave.
        """
        users, items, classes = self._sides
        k = self._k
        seen = written(self._seen.select("user_id", "item_id").distinct().join(users.select("user_id", "cold"), "user_id").join(items.select("item_id", "cls", "place"), "item_id"), "seen")
        most = seen.where("cls is not null and not cold").groupBy("cls", "user_id").agg(F.count(F.lit(1)).alias("m")).groupBy("cls").agg(F.max("m").alias("m"))
        shared = classes.join(most, "cls", "left").select("cls", F.col("vec").alias("shared"), (F.coalesce("m", F.lit(0)) + k).alias("first"))
        kept = items.join(F.broadcast(shared), "cls", "left").where("cls is null or place <= first").select("item_id", F.coalesce("vec", "shared").alias("vec"))
        kept = written(kept, "kept")
        mask = seen.where("not cold").select("user_id", "item_id").join(kept.select("item_id"), "item_id", "left_semi")
        found = self._laid(users.where("not cold"), [(kept, ITEM)], [(mask, SEEN)], "tops", _best(k)).select("user_id", "item_id", "score")
        w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
        warm = found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
        cold = masked_top(users.where("cold").select("user_id"), seen.where("cold"), items.select("item_id", F.col("idx").alias("rank")), k)
        return warm.unionByName(cold.select("user_id", "item_id", F.lit(0.0).alias("score"), "position"))


def product(users: DataFrame, items: DataFrame, truth: DataFrame, seen: DataFrame, k: int = 10, user_block: int | None = None, item_block: int | None = None, big: int = BIG) -> Ranked:
    """users: (user_id, vec) of those to rank for; items: (item_id, vec), the whole catalog; truth and seen: pairs.

    Truth and seen pairs of other users or items don't count. All vectors are of one length; without users or items the
    results are empty. Seen truth pairs are ranked by their score among the unseen items.
    """
    return Ranked(users, items, truth, seen, k, user_block, item_block, big)


def blended(users: DataFrame, items: DataFrame, ranges: DataFrame, pop: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Vectors whose product is alpha * min-max of the content score by user + (1 - alpha) * min-max of log(1 + popularity).

    ranges: each user's least and greatest content score over the catalog, as `product` gives them. The blend is itself a
    factor model with two more dimensions, so it is ranked by blocks too.
    """
    log = pop.select("item_id", F.log1p("score").alias("l"))
    ends = F.broadcast(log.agg(F.min("l").alias("l0"), F.max("l").alias("l1")))  # one row
    p = log.join(ends).select("item_id", F.when(F.col("l1") > F.col("l0"), (F.col("l") - F.col("l0")) / (F.col("l1") - F.col("l0"))).otherwise(0.0).alias("p"))
    wide = items.join(p, "item_id", "left").select("item_id", F.concat("vec", F.array(F.lit(1.0), F.coalesce("p", F.lit(0.0)))).alias("vec"))
    scale = F.when(F.col("high") > F.col("low"), alpha / (F.col("high") - F.col("low"))).otherwise(0.0)
    tall = users.join(ranges, "user_id").withColumn("scale", scale)
    return tall.select("user_id", F.concat(F.transform("vec", lambda x: x * F.col("scale")), F.array(-F.col("low") * F.col("scale"), F.lit(1.0 - alpha))).alias("vec")), wide


def als_vectors(model, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fitted ALS model's vectors of all given users and items; those it doesn't know are zeros."""
    sides = ((model.userFactors, users, "user_id"), (model.itemFactors, items, "item_id"))
    u, v = [filled(ids, f.select(F.col("id").cast("long").alias(key), F.col("features").alias("vec")), key, model.rank) for f, ids, key in sides]
    return u, v
