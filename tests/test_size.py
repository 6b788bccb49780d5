"""Steps whose traffic or memory must not outgrow their input: plans, and results against plain lists."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import analysis, dedup, features, metrics, ranking
from sievework.functions.times import MAIN, SPARSE
from sievework.plans import data as D


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_few_superseded_rows_are_sorted_once(spark):
    at = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(None, 1, at, 2, "b"), (None, 1, at, 1, "a"), (2, 1, at, 1, "c"), (2, 1, at + dt.timedelta(1), 9, "d"), (2, 2, None, 1, "e")], "u long, p long, ts timestamp_ntz, a long, s string")
    got = dedup.keep_latest(df, ["u", "p"], "ts", [F.col("a")], few=True)
    assert rows(got) == rows(dedup.keep_latest(df, ["u", "p"], "ts", [F.col("a")]))
    assert "WindowGroupLimit" not in plan(got)


def test_interactions_by_user_are_the_interactions(spark):
    sf = "/root/testdata/sf0.001"
    found = D.by_user(spark, sf)
    assert rows(found) == rows(D.interactions(spark, sf))
    assert found.select("user_id", F.spark_partition_id().alias("p")).distinct().groupBy("user_id").count().where("count > 1").isEmpty()


def test_masked_ranks_counts_repeated_seen_pairs_once_without_a_distinct(spark):
    ranked = spark.createDataFrame([(10 + r, r) for r in range(1, 9)], "item_id long, rank long")
    seen = spark.createDataFrame([(1, 11), (1, 11), (1, 13), (1, 13), (1, 13), (1, 15), (2, 12)], "user_id long, item_id long")
    truth = spark.createDataFrame([(1, 14), (1, 15), (1, 18), (2, 12), (2, 13)], "user_id long, item_id long")
    got = ranking.masked_ranks(truth, seen, ranked)
    assert rows(got) == [(1, 14, 2), (1, 15, 3), (1, 18, 5), (2, 12, 2), (2, 13, 2)]
    assert "Aggregate" not in logical(got)


def test_masked_top_meets_the_head_of_the_order_only(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    ranked = spark.createDataFrame([(500 - r, r) for r in range(1, 201)], "item_id long, rank long")
    seen = [(int(u), 500 - int(r)) for u, r in zip(rnd.integers(0, 9, 90), rnd.integers(1, 30, 90), strict=True)] + [(8, 500 - r) for r in range(1, 40)]
    want = [(u, 500 - r, i + 1) for u in range(10) for i, r in enumerate([r for r in range(1, 201) if (u, 500 - r) not in seen][:5])]
    users = spark.createDataFrame([(u,) for u in range(10)], "user_id long")
    pairs = spark.createDataFrame(seen, "user_id long, item_id long")
    got = ranking.masked_top(users, pairs, ranked, 5)
    assert rows(got) == sorted(want, key=str)
    monkeypatch.setattr(ranking, "SMALL", 3)
    assert rows(ranking.masked_top(users, pairs, ranked, 5)) == sorted(want, key=str)


def test_head_share_and_novelty_by_item(spark):
    counts = spark.createDataFrame([(i, 1000 - i) for i in range(150)], "item_id long, n long")
    top = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 7, 3), (2, 0, 1), (2, 149, 11)], "user_id long, item_id long, position int")
    assert metrics.head_share(top, counts).first()[0] == 0.75
    mass = sum(1001 - i for i in range(150))
    assert {r[0]: round(r[1], 9) for r in metrics.novelty(top, counts).collect()} == {1: round(float(np.mean([-np.log2((1001 - i) / mass) for i in (0, 1, 7)])), 9), 2: round(float(-np.log2(1001 / mass)), 9)}


def test_churn_share_meets_the_counts_by_item(spark):
    truth = spark.createDataFrame([(u, u % 3) for u in range(20)] + [(1, None)], "user_id long, item_id long")
    train = spark.createDataFrame([(u, 0) for u in range(5)] + [(1, 1), (2, None), (3, None)], "user_id long, item_id long")
    assert tuple(analysis.churn_share(truth, train).first()) == (21, 14 / 21)
    assert "rows" in logical(analysis.churn_share(truth, train))  # a row for each item, not for each truth pair


def test_difference_counts_both_sides_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, None), (2, "y")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, None), (None, None), (3, None)], "k long, s string")
    got = dedup.difference(a, b, 7)
    assert plan(got).count("Exchange") == 1
    assert rows(got) == sorted([(1, "x", "left"), (1, "x", "left"), (None, None, "right"), (3, None, "right")], key=str)
    assert got.columns == ["k", "s", "side"]


def test_tie_groups_sort_nothing(spark):
    at = [dt.datetime(2020, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([(1, 1, at[0]), (1, 1, at[1]), (1, 1, at[1]), (2, 1, at[0]), (2, 1, at[0]), (2, 1, at[1]), (None, 3, at[0]), (None, 3, at[0]), (4, 4, None), (4, 4, None)], "u long, p long, ts timestamp_ntz")
    got = dedup.tie_groups(df, ["u", "p"], "ts", 5)
    assert "Window" not in plan(got) and plan(got).count("Exchange") == 1
    assert rows(got) == sorted([(1, 1, 2), (None, 3, 2)], key=str)


def test_listed_tags_leave_a_task_as_one_row_for_each_tag(spark):
    lists = [("s", 1, "A a b  C"), ("s", 2, "b B \u0130x"), ("s", 3, None), ("s", None, "z z"), (None, 4, "b"), (None, 4, "b c"), ("t", 1, "x a"), ("t", 1, "X y"), ("t", 2, "y")]
    df = spark.createDataFrame(lists, "item_id string, user_id long, tags string")
    plain = df.select("item_id", "user_id", F.explode(F.split("tags", " ")).alias("tag"))
    for k in (2, 10):
        assert rows(features.top_listed_tags(df, k)) == rows(features.top_tags(plain, k))
    once = df.where("item_id = 's'").repartition(1)
    assert rows(features.top_listed_tags(once)) == [("s", ["b", "a", "c", "i\u0307x", "z"])]
    assert "user_id" not in [x.split("#")[0] for line in plan(features.top_listed_tags(once)).splitlines() if "hashpartitioning" in line for x in line.replace("(", " ").replace(",", " ").split()]


def test_timed_pairs_have_the_time_of_their_latest_line(spark):
    sf = "/root/testdata/sf0.001"
    inter, found = D.interactions(spark, sf), D.pairs(spark, sf, SPARSE, timed=True)
    assert rows(found) == rows(inter.select("user_id", "item_id", SPARSE.label(F.col("ts")), "ts"))
    assert "Window" not in plan(found)


def test_pairs_have_the_split_of_their_latest_line_and_sort_no_lines(spark):
    sf = "/root/testdata/sf0.001"
    for splits in (MAIN, SPARSE):
        inter, found = D.interactions(spark, sf), D.pairs(spark, sf, splits)
        assert rows(found) == rows(inter.select("user_id", "item_id", splits.label(F.col("ts"))))
        assert rows(D.segments(found, splits)) == rows(D.segments(inter, splits))
        assert rows(D.part_of(found, splits, "val").select(*D.KEYS)) == rows(D.part_of(inter, splits, "val").select(*D.KEYS))
    at = spark.createDataFrame([(None,), (dt.datetime(1990, 1, 1),), (dt.datetime(1999, 12, 31),), (dt.datetime(2000, 6, 30),), (dt.datetime(2001, 12, 31),), (dt.datetime(2002, 1, 1),)], "ts timestamp_ntz")
    assert [r[0] for r in at.select(MAIN.stage(F.col("ts"))).collect()] == [0, 1, 1, 2, 3, 4]
    assert "Window" not in plan(found) and "l_linenumber" not in plan(found) and "l_quantity" not in plan(found)
