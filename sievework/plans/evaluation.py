"""Queries of the evaluation plane: models, exact ranks, metrics, statistics, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.times import MAIN, SEGMENTS, SPARSE, age_days
from sievework.operators import analysis, factors, features, metrics, models, ranking, stats, vectors
from sievework.plans import data as D
from sievework.sources.scratch import written

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _round(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


#: Popularity at the end of training, its global order and the ranks of validation truth.
_POP = "pop AS (SELECT p_partkey AS item_id, CAST(count(train.user_id) AS DOUBLE) AS score FROM part LEFT JOIN train ON p_partkey = item_id GROUP BY 1), ordered AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pop)"
_RANKS = "ranks AS (SELECT v.user_id, v.item_id, g.rank - (SELECT count(*) FROM train t JOIN ordered h ON t.item_id = h.item_id WHERE t.user_id = v.user_id AND h.rank < g.rank) AS rank FROM val v JOIN ordered g ON v.item_id = g.item_id)"
_MAIN = f"WITH {D.labelled(MAIN)}, {_POP}, {_RANKS}"


def _inter(spark, sf):
    """The interactions, written, as every arm and side reads them: one join and one deduplication."""
    return written(D.by_user(spark, sf).select("user_id", "item_id", "ts", "rating"), "interactions")


def _splits(spark, sf, splits=MAIN):
    inter = _inter(spark, sf)
    return inter, D.part_of(inter, splits, "train"), D.part_of(inter, splits, "val")


def _pairs(spark, sf, timed=False):
    """The pairs with their sparse split, written, for arms that take nothing else of an interaction (`timed`: but its ts); train and validation."""
    inter = written(D.pairs(spark, sf, SPARSE, timed).sortWithinPartitions("user_id", "item_id"), "pairs")
    return inter, D.part_of(inter, SPARSE, "train"), D.part_of(inter, SPARSE, "val")


def _popularity(spark, sf, train):
    n = train.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return written(D.items(spark, sf).select("item_id").join(n, "item_id", "left").fillna({"score": 0.0}), "popularity")


def _pop_ranks(spark, sf):
    inter, train, val = _splits(spark, sf)
    return inter, train, val, ranking.masked_ranks(val, train, ranking.global_rank(_popularity(spark, sf, train)))


@query("popularity_scores", f"WITH {D.labelled(MAIN)} SELECT p_partkey AS item_id, CAST(count(t.user_id) AS DOUBLE) AS score FROM part LEFT JOIN (SELECT * FROM inter WHERE ts <= TIMESTAMP '1999-12-31' AND ts > TIMESTAMP '1999-12-31' - to_days(365)) t ON p_partkey = t.item_id GROUP BY 1")
def popularity_scores(spark, sf):
    grid = features.popularity_grid(D.interactions(spark, sf), ["1999-12-31"], [365])
    return models.popularity(grid, D.items(spark, sf), "1999-12-31", 365)


@query("masked_ranks", _MAIN + " SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank FROM ranks")
def masked_ranks(spark, sf):
    return _pop_ranks(spark, sf)[3].withColumn("rank", F.col("rank").cast("long"))


_TOP = "top AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS position FROM (SELECT DISTINCT user_id FROM val) u CROSS JOIN ordered g WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = g.item_id) QUALIFY position <= 10)"


def _top(spark, sf):
    _, train, val = _splits(spark, sf)
    pop = _popularity(spark, sf, train)
    return train, pop, written(ranking.masked_top(val.select("user_id").distinct(), train, ranking.global_rank(pop), 10), "tops")


@query("masked_top", f"WITH {D.labelled(MAIN)}, {_POP}, {_TOP} SELECT * FROM top")
def masked_top(spark, sf):
    return _top(spark, sf)[2].withColumn("position", F.col("position").cast("long"))


@query("coverage", f"WITH {D.labelled(MAIN)}, {_POP}, {_TOP} SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM part), 6) AS coverage FROM top")
def coverage(spark, sf):
    return _round(metrics.coverage(_top(spark, sf)[2], D.items(spark, sf), 10), "coverage")


@query("novelty", f"WITH {D.labelled(MAIN)}, {_POP}, {_TOP} SELECT user_id, round(avg(-log2((score + 1) / (SELECT sum(score) + count(*) FROM pop))), 6) AS novelty FROM top JOIN pop USING (item_id) GROUP BY 1")
def novelty(spark, sf):
    _, pop, top = _top(spark, sf)
    return _round(metrics.novelty(top, pop.withColumnRenamed("score", "n")), "novelty")


@query("head_share", f"WITH {D.labelled(MAIN)}, {_POP}, {_TOP} SELECT round(avg(CASE WHEN g.rank <= (SELECT ceil(count(*) * 0.01) FROM part) THEN 1.0 ELSE 0 END), 6) AS head_share FROM top JOIN ordered g USING (item_id)")
def head_share(spark, sf):
    _, pop, top = _top(spark, sf)
    return _round(metrics.head_share(top, pop.withColumnRenamed("score", "n")), "head_share")


@query("gini", f"WITH {D.labelled(MAIN)}, {_POP}, s AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS k FROM pop) SELECT round(2 * sum(i * score) / (max(k) * sum(score)) - (max(k) + 1.0) / max(k), 6) AS gini FROM s")
def gini(spark, sf):
    _, train, _ = _splits(spark, sf)
    return _round(metrics.gini(_popularity(spark, sf, train).withColumnRenamed("score", "n")), "gini")


_PER = """n AS (SELECT user_id, count(*) AS n, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, min(rank) AS best, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS g10, sum(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS g20 FROM ranks GROUP BY 1),
 ideal AS (SELECT j AS n, sum(1 / log2(j + 1)) OVER (ORDER BY j) AS i FROM range(1, 21) r(j)),
 per AS (SELECT user_id, h10 / n.n AS recall_10, h20 / n.n AS recall_20, CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_10, 1.0 / best AS mrr, g10 / a.i AS ndcg_10, g20 / b.i AS ndcg_20 FROM n JOIN ideal a ON a.n = least(n.n, 10) JOIN ideal b ON b.n = least(n.n, 20))"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)


@query("user_metrics", f"{_MAIN}, {_PER} SELECT user_id, {_ROUNDED} FROM per")
def user_metrics(spark, sf):
    return _round(metrics.per_user(_pop_ranks(spark, sf)[3]), *metrics.METRICS)


_SEG = """seg AS (SELECT user_id, n_train, CASE WHEN n_train <= 0 THEN '0' WHEN n_train <= 4 THEN '1-4' WHEN n_train <= 9 THEN '5-9' WHEN n_train <= 19 THEN '10-19' ELSE '20+' END AS segment,
 CASE WHEN n_train <= 0 THEN '0' WHEN n_train <= 4 THEN '1-4' WHEN n_train <= 9 THEN '5-9' WHEN n_train <= 19 THEN '10-19' WHEN n_train <= 49 THEN '20-49' WHEN n_train <= 99 THEN '50-99' ELSE '100+' END AS deep
 FROM (SELECT user_id, count(*) FILTER (split = 'train') AS n_train FROM lab GROUP BY 1))"""


@query("segment_means", f"{_MAIN}, {_PER}, {_SEG} SELECT coalesce(segment, 'all') AS segment, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS) + ", count(*) AS users FROM per JOIN seg USING (user_id) GROUP BY GROUPING SETS ((segment), ())")
def segment_means(spark, sf):
    inter, _, _, ranks = _pop_ranks(spark, sf)
    m = metrics.per_user(ranks).join(D.segments(inter, MAIN), "user_id")
    return _round(metrics.means(m, "segment").withColumn("segment", F.coalesce("segment", F.lit("all"))), *metrics.METRICS)


@query("segments", f"WITH {D.labelled(SPARSE)}, {_SEG} SELECT * FROM seg")
def segments(spark, sf):
    return D.segments(D.interactions(spark, sf), SPARSE)


@query("category_shares", f"WITH {D.labelled(MAIN)} SELECT user_id, p_type AS category, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM train JOIN part ON p_partkey = item_id GROUP BY 1, 2")
def category_shares(spark, sf):
    _, train, _ = _splits(spark, sf)
    return _round(models.category_shares(train, D.items(spark, sf)), "share")


_KNN = "pairs AS (SELECT DISTINCT user_id, item_id FROM train WHERE ts > TIMESTAMP '1995-06-30' - to_days(365)), cnt AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY 1), co AS (SELECT a.item_id, b.item_id AS neighbour, count(*) AS c FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2), sim AS (SELECT co.item_id, neighbour, c / (sqrt(x.n::DOUBLE * y.n) + 2.0) AS similarity FROM co JOIN cnt x ON x.item_id = co.item_id JOIN cnt y ON y.item_id = neighbour), top AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, neighbour) <= 50)"


def _sparse_knn(spark, sf):
    inter, train, val = _splits(spark, sf, SPARSE)
    aged = train.withColumn("age_days", age_days(F.col("ts"), "1995-06-30"))
    return inter, train, val, models.item_knn(aged, shrink=2.0, top=50, window_days=365)


@query("item_knn", f"WITH {D.labelled(SPARSE)}, {_KNN} SELECT item_id, neighbour, round(similarity, 6) AS similarity FROM top")
def item_knn(spark, sf):
    return _round(_sparse_knn(spark, sf)[3], "similarity")


@query("knn_scores", f"WITH {D.labelled(SPARSE)}, {_KNN} SELECT t.user_id, top.item_id, round(sum(similarity), 6) AS score FROM (SELECT DISTINCT user_id, item_id FROM train) t JOIN top ON t.item_id = top.neighbour GROUP BY 1, 2")
def knn_scores(spark, sf):
    _, train, _, similar = _sparse_knn(spark, sf)
    return _round(models.knn_scores(train, similar), "score")


@query("category_ranks", f"""WITH {D.labelled(SPARSE)}, pop AS (SELECT item_id, count(*) AS score FROM train GROUP BY 1), share AS (SELECT user_id, p_type AS category, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM train JOIN part ON p_partkey = item_id GROUP BY 1, 2),
 gt AS (SELECT user_id, item_id FROM val WHERE user_id IN (SELECT user_id FROM train)), s AS (SELECT u.user_id, p_partkey AS item_id, round(coalesce(share * score, 0), 9) AS score FROM (SELECT DISTINCT user_id FROM gt) u CROSS JOIN part LEFT JOIN pop ON p_partkey = pop.item_id LEFT JOIN share ON share.user_id = u.user_id AND category = p_type WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p_partkey)),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT user_id, item_id, rank FROM r SEMI JOIN gt USING (user_id, item_id)""")
def category_ranks(spark, sf):
    _, train, val = _splits(spark, sf, SPARSE)
    items = D.items(spark, sf).select("item_id", F.coalesce("category", F.lit("__unknown__")).alias("category"))
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    scored = items.join(pop, "item_id", "left").fillna({"score": 0.0})
    warm = val.join(train.select("user_id").distinct(), "user_id", "left_semi")
    return ranking.shared_ranks(warm, train, models.category_shares(train, items), scored, 9)


@query("random_ranks")
def random_ranks(spark, sf):
    _, train, val = _splits(spark, sf, SPARSE)
    return models.random_scores(val.select("user_id", "item_id"), 20260805)


@query("als_scores")
def als_scores(spark, sf):
    _, train, val = _pairs(spark, sf)
    return models.als(train).transform(val.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"))).select("user_id", "item_id", "prediction")


@query("hybrid_users", f"WITH {D.labelled(SPARSE)}, {_SEG}, {_POP} SELECT v.user_id, v.item_id, CASE WHEN n_train < 5 THEN p.score ELSE -p.score END AS score FROM val v JOIN seg USING (user_id) JOIN pop p ON p.item_id = v.item_id")
def hybrid_users(spark, sf):
    inter, train, val = _splits(spark, sf, SPARSE)
    low = val.select("user_id", "item_id").join(_popularity(spark, sf, train), "item_id").select("user_id", "item_id", "score")
    return models.hybrid(low, low.withColumn("score", -F.col("score")), D.segments(inter, SPARSE), 5)


@query("support_shares", f"WITH {D.labelled(SPARSE)}, s AS (SELECT v.*, (SELECT count(*) FROM train t WHERE t.item_id = v.item_id) AS n FROM val v) SELECT CASE WHEN n = 0 THEN 'zero' WHEN n <= 4 THEN 'low' ELSE 'ok' END AS regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1")
def support_shares(spark, sf):
    _, train, val = _splits(spark, sf, SPARSE)
    return _round(analysis.bucket_shares(analysis.support(val, train), "regime"), "share")


@query("churn_share", f"WITH {D.labelled(SPARSE)}, s AS (SELECT (SELECT count(*) FROM train t WHERE t.item_id = v.item_id) AS n FROM val v) SELECT count(*) AS n, round(avg(CASE WHEN n <= 4 THEN 1.0 ELSE 0 END), 6) AS share, CASE WHEN avg(CASE WHEN n <= 4 THEN 1.0 ELSE 0 END) < 0.1 THEN 'wrong' WHEN avg(CASE WHEN n <= 4 THEN 1.0 ELSE 0 END) < 0.25 THEN 'partial' ELSE 'supported' END AS verdict FROM s")
def churn_share(spark, sf):
    _, train, val = _splits(spark, sf, SPARSE)
    return _round(analysis.churn_share(val, train).withColumn("verdict", analysis.gate_verdict(F.col("share"))), "share")


@query("recall_ceiling", f"WITH {D.labelled(SPARSE)}, {_SEG}, c AS (SELECT item_id, count(*) AS k FROM train GROUP BY 1), s AS (SELECT segment, deep, coalesce(k, 0) AS k FROM val JOIN seg USING (user_id) LEFT JOIN c USING (item_id)) SELECT coalesce(segment, '-') AS segment, coalesce(deep, '-') AS deep, count(*) AS n, round(avg(CASE WHEN k >= 1 THEN 1.0 ELSE 0 END), 6) AS at_least_1, round(avg(CASE WHEN k >= 5 THEN 1.0 ELSE 0 END), 6) AS at_least_5 FROM s GROUP BY GROUPING SETS ((segment), (deep), ())")
def recall_ceiling(spark, sf):
    inter, train, val = _splits(spark, sf, SPARSE)
    out = analysis.recall_ceiling(val, train, D.segments(inter, SPARSE))
    return _round(out.fillna("-", ["segment", "deep"]), "at_least_1", "at_least_5")


@query("regime_cells", f"{_MAIN}, {_SEG}, c AS (SELECT item_id, count(*) AS k FROM train GROUP BY 1), p AS (SELECT user_id, CASE WHEN coalesce(k, 0) = 0 THEN 'zero' WHEN k <= 4 THEN 'low' ELSE 'ok' END AS regime, count(*) AS n, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall FROM ranks LEFT JOIN c USING (item_id) GROUP BY 1, 2) SELECT segment, regime, count(*) AS users, CAST(sum(n) AS BIGINT) AS n, round(avg(recall), 6) AS recall_10 FROM p JOIN seg USING (user_id) GROUP BY 1, 2")
def regime_cells(spark, sf):
    inter, train, val, ranks = _pop_ranks(spark, sf)
    regimes = analysis.support(val.select("item_id").distinct(), train)
    return _round(analysis.regime_cells(ranks, regimes, D.segments(inter, MAIN)), "recall_10")


@query("routing_grid", f"{_MAIN}, {_PER}, {_SEG} SELECT CAST(g AS BIGINT) AS threshold, round(avg(CASE WHEN n_train < g THEN ndcg_10 ELSE recall_10 END), 6) AS objective FROM per JOIN seg USING (user_id) CROSS JOIN (VALUES (0), (10), (20), (30), (40), (50)) t(g) GROUP BY 1")
def routing_grid(spark, sf):
    inter, _, _, ranks = _pop_ranks(spark, sf)
    m = metrics.per_user(ranks)
    grid = analysis.routing_grid(m.select("user_id", F.col("ndcg_10").alias("m")), m.select("user_id", F.col("recall_10").alias("m")), D.segments(inter, MAIN), "m", [0, 10, 20, 30, 40, 50])
    return _round(grid.withColumn("threshold", F.col("threshold").cast("long")), "objective")


@query("bootstrap_segments")
def bootstrap_segments(spark, sf):
    inter, _, _, ranks = _pop_ranks(spark, sf)
    m = metrics.per_user(ranks).join(D.segments(inter, MAIN), "user_id")
    return stats.segment_intervals(m, "segment", "ndcg_10", {s: i for i, s in enumerate(SEGMENTS)})


@query("compare_arms")
def compare_arms(spark, sf):
    inter, _, _, ranks = _pop_ranks(spark, sf)
    m = metrics.per_user(ranks)
    return stats.compare_arms(m.select("user_id", F.col("ndcg_10").alias("m")), m.select("user_id", F.col("recall_10").alias("m")), "m", D.segments(inter, MAIN))


@query("q_values", """WITH t AS (SELECT 'f' || (l_linenumber % 3) AS family, CAST(l_linenumber AS VARCHAR) AS label, round(avg(l_discount) * 3 - 0.1, 6) AS p FROM lineitem GROUP BY l_linenumber),
 r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, label) AS i, count(*) OVER (PARTITION BY family) AS m FROM t)
 SELECT family, label, p, round(least(1.0, min(m * p / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def q_values(spark, sf):
    t = D.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_discount") * 3 - 0.1, 6).alias("p"))
    t = t.select(F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("family"), F.col("l_linenumber").cast("string").alias("label"), "p")
    return _round(stats.q_values(t, ["family"]), "q")


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"


@query("cosine_top", f"WITH {_VEC}, s AS (SELECT q.vec_id AS query, u.vec_id, round(list_inner_product(q.e, u.e), 9) AS score FROM u q JOIN u ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id) SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS position FROM s QUALIFY position <= 10")
def cosine_top(spark, sf):
    u = vectors.unit(D.table(spark, sf, "embeddings"))
    return vectors.cosine_top(u, u.where("vec_id % 100 = 0"), 10).select("query", "vec_id", F.col("position").cast("long").alias("position"))


@query("ann_overlap")
def ann_overlap(spark, sf):
    u = vectors.unit(D.table(spark, sf, "embeddings"))
    asked = u.where("vec_id % 100 = 0")
    index, frame = vectors.lsh(u, length=2.0)
    return vectors.overlap(vectors.cosine_top(u, asked, 10), vectors.approx_top(index, frame, asked, 10, 2.0), 10)


#: Cells of the inverted file and how many a query probes. The given vectors hardly cluster, so most cells must be probed.
CELLS, PROBES = 32, 22


@query("ivf_overlap")
def ivf_overlap(spark, sf):
    """Overlap@10 with the exact lists over the id % 100 queries, and the share of pairs that were compared."""
    u = written(vectors.unit(D.table(spark, sf, "embeddings")), "unit")
    asked = u.where("vec_id % 100 = 0")
    centres = vectors.fit_centres(u, CELLS)
    index = written(vectors.nearest_cells(u, centres, 1), "cells")
    found = vectors.overlap(vectors.cosine_top(u, asked, 10), vectors.ivf_top(index, asked, centres, 10, PROBES), 10)
    return found.join(vectors.compared_share(index, asked, centres, PROBES))


@query("int8_codes", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS scale FROM v) SELECT vec_id, round(scale, 9) AS scale, CAST(round_even(e[1] / scale, 0) AS BIGINT) AS first, CAST(list_sum(list_transform(e, lambda x: round_even(x / scale, 0))) AS BIGINT) AS total FROM s")
def int8_codes(spark, sf):
    q = D.table(spark, sf, "embeddings").select("vec_id", vectors.quantise(F.col("embedding")).alias("q"))
    total = F.aggregate(F.col("q.codes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.element_at("q.codes", 1).cast("long").alias("first"), total.alias("total"))


@query("facet_filter", "SELECT p_partkey AS item_id FROM part WHERE p_brand = 'Brand#11' AND p_retailprice <= 1500")
def facet_filter(spark, sf):
    return vectors.facet(D.items(spark, sf), "Brand#11", 1500.0).select("item_id")


@query("popular_slice", f"WITH {D.labelled(MAIN)}, {_POP} SELECT item_id, score FROM ordered WHERE rank <= 25")
def popular_slice(spark, sf):
    _, train, _ = _splits(spark, sf)
    return ranking.global_rank(_popularity(spark, sf, train)).where("rank <= 25").select("item_id", "score")


@query("content_profiles")
def content_profiles(spark, sf):
    _, train, _ = _splits(spark, sf, SPARSE)
    vecs = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return models.profiles(train, vecs)


@query("blend_scores", f"WITH {D.labelled(SPARSE)}, {_POP}, mm AS (SELECT item_id, (ln(1 + score) - min(ln(1 + score)) OVER ()) / (max(ln(1 + score)) OVER () - min(ln(1 + score)) OVER ()) AS p FROM pop), c AS (SELECT user_id, item_id, CAST(rating AS DOUBLE) AS s FROM val), n AS (SELECT *, min(s) OVER (PARTITION BY user_id) AS lo, max(s) OVER (PARTITION BY user_id) AS hi FROM c) SELECT user_id, item_id, round(0.3 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END + 0.7 * p, 6) AS score FROM n JOIN mm USING (item_id)")
def blend_scores(spark, sf):
    _, train, val = _splits(spark, sf, SPARSE)
    content = val.select("user_id", "item_id", F.col("rating").cast("double").alias("score"))
    return _round(models.blend(content, _popularity(spark, sf, train), 0.3), "score")


@query("curated_users")
def curated_users(spark, sf):
    inter, _, _, ranks = _pop_ranks(spark, sf)
    m = metrics.per_user(ranks).join(D.segments(inter, MAIN), "user_id").select("user_id", "segment", (F.col("hit_10") > 0).alias("hit"))
    return analysis.curate(m, 2, 4, 7)


#: Content scores of all users with validation truth over the whole catalog: items without a vector and cold users score 0.
_CONTENT = f"""WITH {D.labelled(SPARSE)}, u AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)),
 unit AS (SELECT item_id, CASE WHEN list_inner_product(e, e) > 0 THEN list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) ELSE e END AS e FROM u),
 long AS (SELECT user_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM train JOIN unit USING (item_id)),
 mean AS (SELECT user_id, list(x ORDER BY i) AS e FROM (SELECT user_id, i, avg(x) AS x FROM long GROUP BY 1, 2) GROUP BY 1),
 profile AS (SELECT user_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM mean),
 asked AS (SELECT DISTINCT user_id FROM val),
 content AS MATERIALIZED (SELECT user_id, p_partkey AS item_id, coalesce(round(list_inner_product(profile.e, unit.e), 9), 0) AS score FROM asked CROSS JOIN part LEFT JOIN profile USING (user_id) LEFT JOIN unit ON unit.item_id = p_partkey)"""
_UNSEEN = "SELECT * FROM {scores} s WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = s.item_id)"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (" + _UNSEEN + "))"
_SPARSE_POP = "pop AS (SELECT p_partkey AS item_id, CAST(count(train.user_id) AS DOUBLE) AS score FROM part LEFT JOIN train ON p_partkey = item_id GROUP BY 1)"
_BLEND = (
    _CONTENT + f", {_SPARSE_POP}, mm AS (SELECT item_id, (ln(1 + score) - min(ln(1 + score)) OVER ()) / (max(ln(1 + score)) OVER () - min(ln(1 + score)) OVER ()) AS p FROM pop),"
    " ends AS (SELECT user_id, min(score) AS lo, max(score) AS hi FROM content GROUP BY 1),"
    " blend AS MATERIALIZED (SELECT c.user_id, c.item_id, round(CASE WHEN hi > lo THEN 0.3 / (hi - lo) * (c.score - lo) ELSE 0 END + 0.7 * p, 9) AS score FROM content c JOIN ends USING (user_id) JOIN mm USING (item_id))"
)


def _content(spark, sf, timed=False):
    """train, validation truth, user profiles and item vectors, zeros where there are none."""
    inter, train, val = _pairs(spark, sf, timed)
    vecs = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    items = D.items(spark, sf).select("item_id")
    unit = vecs.join(items, "item_id", "left_semi").select("item_id", models.l2(F.transform("vec", lambda x: x.cast("double"))).alias("vec"))
    dims = vecs.select(F.max(F.size("vec"))).first()[0]
    users = factors.filled(val.select("user_id"), models.profiles(train, unit).withColumnRenamed("profile", "vec"), "user_id", dims)
    return inter, train, val, users, factors.filled(items, unit, "item_id", dims)


@query("content_ranks", _CONTENT + ", " + _RANKED.format(scores="content") + " SELECT user_id, item_id, rank FROM r SEMI JOIN val USING (user_id, item_id)")
def content_ranks(spark, sf):
    _, train, val, users, items = _content(spark, sf)
    return factors.product(users, items, val, train, 0).ranks


@query("content_top", _CONTENT + ", " + _RANKED.format(scores="content") + " SELECT user_id, item_id, rank AS position FROM r WHERE rank <= 10")
def content_top(spark, sf):
    _, train, val, users, items = _content(spark, sf)
    return factors.product(users, items, val, train, 10).top.select("user_id", "item_id", F.col("position").cast("long").alias("position"))


def _blend_arm(spark, sf):
    """Ranks of the blend; of the content product only the ranges are asked, so no truth meets it."""
    _, train, val, users, items = _content(spark, sf)
    content = factors.product(users, items, val.limit(0), train.limit(0), 0)
    u, v = factors.blended(users, items, content.ranges, _popularity(spark, sf, train), 0.3)
    return factors.product(u, v, val, train, 0).ranks


@query("blend_ranks", _BLEND + ", " + _RANKED.format(scores="blend") + " SELECT user_id, item_id, rank FROM r SEMI JOIN val USING (user_id, item_id)")
def blend_ranks(spark, sf):
    return _blend_arm(spark, sf)


@query("hybrid_ranks", _CONTENT + f", {_SPARSE_POP}, ordered AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pop), {_RANKS}, {_SEG}, " + _RANKED.format(scores="content") + " SELECT user_id, item_id, CASE WHEN n_train < 10 THEN ranks.rank ELSE r.rank END AS rank FROM r JOIN ranks USING (user_id, item_id) JOIN seg USING (user_id)")
def hybrid_ranks(spark, sf):
    """Users with fewer than ten train items by popularity, the others by content."""
    inter, train, val, users, items = _content(spark, sf)
    low = written(D.segments(inter, SPARSE).select("user_id", (F.col("n_train") < 10).alias("low")), "low_users")
    few, many = ((lambda df, side=side: df.join(low.where(side).select("user_id"), "user_id", "left_semi")) for side in ("low", "not low"))  # each model ranks its own users only
    popular = ranking.masked_ranks(few(val), few(train), ranking.global_rank(_popularity(spark, sf, train))).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))
    return popular.unionByName(factors.product(many(users), items, many(val), many(train), 0).ranks)


def _als(spark, sf, k):
    _, train, val = _pairs(spark, sf)
    users, items = factors.als_vectors(models.als(train), val.select("user_id"), D.items(spark, sf))
    return factors.product(users, items, val, train, k)


@query("als_ranks")
def als_ranks(spark, sf):
    return _als(spark, sf, 0).ranks


@query("als_top")
def als_top(spark, sf):
    return _als(spark, sf, 10).top
