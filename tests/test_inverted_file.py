"""The inverted file: recall and share of compared pairs on clustered vectors, edge cases."""

import numpy as np

from sievework.operators import vectors


def table(spark, x):
    return vectors.unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4))


def test_recall_and_share_on_clusters(spark):
    rnd = np.random.default_rng(6)
    middle = rnd.normal(size=(40, 24))
    u = table(spark, middle[rnd.integers(0, 40, 3000)] + 0.25 * rnd.normal(size=(3000, 24)))
    asked = u.where("vec_id % 100 = 0")
    centres = vectors.fit_centres(u, 40, sample=1500)
    index = vectors.nearest_cells(u, centres, 1).cache()
    assert centres.shape == (40, 24) and index.count() == 3000
    found = vectors.ivf_top(index, asked, centres, 10, 4)
    assert vectors.overlap(vectors.cosine_top(u, asked, 10), found, 10).first()[0] >= 0.9
    share = vectors.compared_share(index, asked, centres, 4).first()[0]
    compared = vectors.nearest_cells(asked, centres, 4).select("vec_id", "cell").join(index.select("cell"), "cell").count()
    assert share < 0.2 and abs(share - compared / (30 * 3000)) < 1e-9
    assert vectors.overlap(vectors.cosine_top(u, asked, 10), vectors.ivf_top(index, asked, centres, 10, 40), 10).first()[0] == 1.0


def test_few_and_equal_vectors(spark):
    u = table(spark, np.ones((5, 3)))
    centres = vectors.fit_centres(u, 8)
    assert len(centres) == 5
    top = vectors.ivf_top(vectors.nearest_cells(u, centres, 1), u.where("vec_id = 2"), centres, 3, 8)
    assert [(r["position"], r["vec_id"]) for r in top.orderBy("position").collect()] == [(1, 0), (2, 1), (3, 3)]
    assert vectors.fit_centres(u.limit(0), 8).shape == (0, 0)


def test_search_makes_no_row_for_a_pair(spark):
    """Exact and hashed lists come from block products, whatever the blocks; equal vectors go by id."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(400, 8))
    x[200:260] = x[7]
    u = table(spark, x)
    asked = u.where("vec_id % 10 = 7")
    exact = vectors.cosine_top(u, asked, 5, block=6)
    assert "Join" not in exact._jdf.queryExecution().optimizedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    want = {(a, p + 1): int(order[a, p]) for a in range(7, 400, 10) for p in range(5)}
    assert {(r["query"], r["position"]): r["vec_id"] for r in exact.collect()} == want
    index, frame = vectors.lsh(u, length=50.0)  # each table's buckets lie on both sides of 0
    near = vectors.approx_top(index, frame, asked, 5, 2.1, block=6)
    assert "Join" not in str(near._jdf.queryExecution().optimizedPlan().toString()).replace("Join LeftSemi", "")
    assert vectors.overlap(exact, near, 5).first()[0] > 0.9
    assert {r["vec_id"] for r in near.where("query = 7").collect()} == set(range(200, 205))
