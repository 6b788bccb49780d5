"""Blocked factor products against a dense product on the driver."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.operators import factors, models
from sievework.plans import evaluation


@pytest.fixture(scope="module")
def small(spark):
    rnd = np.random.default_rng(8)
    u, v = rnd.normal(size=(23, 6)).round(1), rnd.normal(size=(31, 6)).round(1)
    u[4], v[7], v[9] = 0, 0, v[8]  # a cold user, an item without a vector, equal items
    users = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(u)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    seen = sorted({(100 + int(a), 3 * int(b)) for a, b in rnd.integers(0, (23, 31), (120, 2))})
    truth = sorted({(100 + int(a), 3 * int(b)) for a, b in rnd.integers(0, (23, 31), (90, 2))} - set(seen))
    pair = lambda rows: spark.createDataFrame([*rows, (999, 3), (101, 1000)], "user_id long, item_id long")
    return u, v, users, items, seen, truth, pair(seen), pair(truth)


def dense(u, v, seen):
    score = np.round(u @ v.T, 9) + 0.0
    masked = score.copy()
    for a, b in seen:
        masked[a - 100, b // 3] = -np.inf
    order = np.argsort(-masked, axis=1, kind="stable")
    return score, masked, order


@pytest.mark.parametrize(("user_block", "item_block"), [(4096, 16_384), (5, 4), (1, 31)])
def test_product(small, user_block, item_block):
    u, v, users, items, seen, truth, seen_df, truth_df = small
    score, masked, order = dense(u, v, seen)
    found = factors.product(users, items, truth_df, seen_df, 4, user_block, item_block)
    want = {(a, b): int(np.flatnonzero(order[a - 100] == b // 3)[0]) + 1 for a, b in truth}
    assert {(r["user_id"], r["item_id"]): r["rank"] for r in found.ranks.collect()} == want
    top = {(100 + a, p + 1): (3 * int(order[a, p]), masked[a, order[a, p]]) for a in range(23) for p in range(4)}
    assert {(r["user_id"], r["position"]): (r["item_id"], r["score"]) for r in found.top.collect()} == top
    assert {r["user_id"]: (r["low"], r["high"]) for r in found.ranges.collect()} == {100 + a: (score[a].min(), score[a].max()) for a in range(23)}


def test_product_of_few_items_and_of_nothing(small):
    u, v, users, items, seen, truth, seen_df, truth_df = small
    few = factors.product(users, items.where("item_id < 9"), truth_df, seen_df, 10)
    assert few.top.count() == 23 * 3 - sum(b < 9 for _, b in seen)
    none = factors.product(users.limit(0), items, truth_df, seen_df, 10)
    assert none.ranks.count() == none.top.count() == none.ranges.count() == 0


def test_blend_is_a_product(spark, small):
    u, v, users, items, seen, truth, seen_df, truth_df = small
    pop = spark.createDataFrame([(3 * i, float(i % 7)) for i in range(31)], "item_id long, score double")
    content = factors.product(users, items, truth_df, seen_df, 0)
    bu, bv = factors.blended(users, items, content.ranges, pop, 0.3)
    found = factors.product(bu, bv, truth_df, seen_df, 3)
    score = np.round(u @ v.T, 9)
    low, high = score.min(1, keepdims=True), score.max(1, keepdims=True)
    log = np.log1p(np.arange(31) % 7)
    blend = 0.3 * np.where(high > low, (score - low) / np.where(high > low, high - low, 1), 0) + 0.7 * log / log.max()
    for a, b in seen:
        blend[a - 100, b // 3] = -np.inf
    order = np.argsort(-np.round(blend, 9), axis=1, kind="stable")
    assert {(r["user_id"], r["item_id"]): r["rank"] for r in found.ranks.collect()} == {(a, b): int(np.flatnonzero(order[a - 100] == b // 3)[0]) + 1 for a, b in truth}


def test_als_ranks(spark):
    rnd = np.random.default_rng(2)
    train = spark.createDataFrame(sorted({(int(a), int(b), 1) for a, b in rnd.integers(0, (30, 20), (250, 2))}), "user_id long, item_id long, rating long")
    model = models.als(train, rank=4, iterations=2)
    users, items = spark.range(0, 33).withColumnRenamed("id", "user_id"), spark.range(0, 22).withColumnRenamed("id", "item_id")
    u, v = factors.als_vectors(model, users, items)
    truth = users.crossJoin(items).where("(user_id + item_id) % 5 = 0").join(train, ["user_id", "item_id"], "left_anti")
    found = factors.product(u, v, truth, train, 5, 7, 6)
    mats = [np.array([r["vec"] for r in df.orderBy(key).collect()]) for df, key in ((u, "user_id"), (v, "item_id"))]
    assert not mats[0][30:].any() and not mats[1][20:].any()
    score = np.round(mats[0] @ mats[1].T, 9) + 0.0
    for r in train.collect():
        score[r["user_id"], r["item_id"]] = -np.inf
    order = np.argsort(-score, axis=1, kind="stable")
    ranks = {(r["user_id"], r["item_id"]): r["rank"] for r in found.ranks.collect()}
    assert len(ranks) == truth.count() and all(order[a, n - 1] == b for (a, b), n in ranks.items())
    assert {(r["user_id"], r["position"]): r["item_id"] for r in found.top.collect()} == {(a, p + 1): int(order[a, p]) for a in range(33) for p in range(5)}


@pytest.mark.parametrize("big", [2, 5])
def test_classes_of_equal_vectors(spark, monkeypatch, big):
    """Large classes, ties between classes and with single items, cold users; columns are counted, not items."""
    rnd = np.random.default_rng(5)
    u, v = rnd.integers(-2, 3, (19, 3)).astype(float), rnd.integers(-1, 2, (90, 3)).astype(float)
    u[3] = u[11] = 0
    v[::3] = 0
    users = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(u)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    seen = sorted({(100 + int(a), 3 * int(b)) for a, b in rnd.integers(0, (19, 90), (200, 2))})
    truth = sorted({(100 + int(a), 3 * int(b)) for a, b in rnd.integers(0, (19, 90), (300, 2))} - set(seen))
    score, masked, order = dense(u, v, seen)
    pair = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long")
    found = factors.product(users, items, pair(truth), pair(seen), 6, 7, 8, big)
    assert {(r["user_id"], r["item_id"]): r["rank"] for r in found.ranks.collect()} == {(a, b): int(np.flatnonzero(order[a - 100] == b // 3)[0]) + 1 for a, b in truth}
    assert {(r["user_id"], r["position"]): r["item_id"] for r in found.top.collect()} == {(100 + a, p + 1): 3 * int(order[a, p]) for a in range(19) for p in range(6)}
    assert {r["user_id"]: (r["low"], r["high"]) for r in found.ranges.collect()} == {100 + a: (score[a].min(), score[a].max()) for a in range(19)}
    _, sided, classes = found._sides
    assert classes.count() + sided.where("cls is null").count() < 60 and sided.where("cls is not null and vec is not null").count() == 0


def test_norms_are_worked_out_once(spark):
    """Nested unit vectors: the plan holds each norm once, not once for every component of every level."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(models.l2(models.l2(models.l2(F.col("v")))).alias("v"))
    assert np.allclose([r[0] for r in df.collect()], [[0.6, 0.8], [0, 0]])
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("SQRT(") == 3


def test_arms_read_written_interactions(spark):
    train = evaluation._splits(spark, "/root/testdata/sf0.001")[1]
    assert all("/interactions-" in f for f in train.inputFiles())


def test_many_truth_items_of_a_user(small, monkeypatch):
    """Sorted rows give the ranks that single comparisons give, with ties and over several blocks."""
    u, v, users, items, seen, truth, seen_df, truth_df = small
    ranks = []
    for many in (1, 3, 10**9):
        monkeypatch.setattr(factors, "MANY", many)
        rows = factors._counts(_laid_out(u, v, truth))
        ranks.append({(a, b): n for kind, a, b, n in zip(*(rows[c].to_pylist() for c in ("kind", "user_id", "item_id", "n")), strict=True) if kind == factors.ABOVE})
    _, _, order = dense(u, v, [])
    assert ranks[0] == ranks[1] == ranks[2] == {(a, b): int(np.flatnonzero(order[a - 100] == b // 3)[0]) for a, b in truth}


def _laid_out(u, v, truth):
    score = np.round(u @ v.T, 9) + 0.0
    rows = [(factors.USER, 100 + i, None, x.tolist(), None, None) for i, x in enumerate(u)] + [(factors.ITEM, None, 3 * i, x.tolist(), None, None) for i, x in enumerate(v)]
    rows += [(factors.TRUTH, a, b, None, float(score[a - 100, b // 3]), -1) for a, b in truth]
    kinds = (("kind", pa.int32()), ("user_id", pa.int64()), ("item_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("score", pa.float64()), ("n", pa.int64()))
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def test_columns_travel_once_for_large_blocks_of_users(spark, monkeypatch):
    """The blocks of a product of many users follow memory, not a small count of users."""
    monkeypatch.setattr(factors, "written", lambda df, name: df)
    users = spark.range(60_000).select(F.col("id").alias("user_id"), F.array(F.lit(1.0)).alias("vec"))
    items = spark.range(5).select(F.col("id").alias("item_id"), F.array(F.lit(2.0)).alias("vec"))
    none = spark.range(0).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"))
    found = factors.product(users, items, none, none)
    plan = found._laid(users, [(items, factors.ITEM)], [], "x", factors._counts)._jdf.queryExecution().logical().toString()
    cut = [int(x) for x in re.findall(r"sequence\(0, (\d+)", plan)]
    assert max(cut) < 24


@pytest.mark.parametrize("wide", [3, 8, 16_384])
def test_best_partitions_a_users_scores_once(small, monkeypatch, wide):
    """The k best over several chunks of columns, with ties and seen items; later chunks are held against the first one's bound."""
    u, v, users, items, seen, truth, *_ = small
    rows = _laid_out(u, v, [])
    mask = [(factors.SEEN, a, b, None, None, None) for a, b in seen]
    rows = pa.concat_tables([rows, pa.table([pa.array(c, t) for c, t in zip(zip(*mask, strict=True), rows.schema.types, strict=True)], names=rows.column_names)])
    taken, partition = [], np.partition
    monkeypatch.setattr(factors, "WIDE", wide)
    monkeypatch.setattr(factors.np, "partition", lambda x, *a, **b: taken.append(len(x)) or partition(x, *a, **b))
    got = factors._best(4)(rows)
    _, masked, order = dense(u, v, seen)
    want = {(100 + a, 3 * int(order[a, p]), masked[a, order[a, p]]) for a in range(23) for p in range(4)}
    assert set(zip(*(got[c].to_pylist() for c in ("user_id", "item_id", "score")), strict=True)) == want
    assert wide != 8 or 23 <= sum(taken) < 3 * 23


def test_one_block_of_columns_gives_ranks_without_adding_up(small):
    *_, users, items, _, _, seen_df, truth_df = small
    found = factors.product(users, items, truth_df, seen_df)
    assert "Aggregate" not in found.ranks._jdf.queryExecution().optimizedPlan().toString()


def test_arms_multiply_only_what_they_ask_for(spark, monkeypatch):
    """A hybrid's product has the users of its own side, and a blend asks no ranks of the content product."""
    sf, product, asked = "/root/testdata/sf0.001", factors.product, []
    monkeypatch.setattr(factors, "product", lambda u, v, truth, seen, k: asked.append((u.count(), truth.count())) or product(u, v, truth, seen, k))
    evaluation.hybrid_ranks(spark, sf)
    evaluation.blend_ranks(spark, sf)
    (hybrid, _), (everyone, none), (_, some) = asked
    assert hybrid < everyone and none == 0 < some
