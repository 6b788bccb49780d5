import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import checks, text
from sievework.functions.times import DEEP, DEEP_EDGES, Splits, bucket
from sievework.operators import analysis, contracts, dedup, features, maintenance, metrics, models, ranking, stats, vectors
from sievework.operators.kcore import kcore
from sievework.sources.files import CORRUPT, check_header, read_json_lines, split_corrupt
from sievework.sources.versions import Catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_functions(spark):
    df = spark.createDataFrame([(" $12.50 ", "a\x01b"), ("1-2", " "), (None, None)], "p string, t string")
    got = df.select(text.parse_price(F.col("p")), text.control_to_space(F.col("t")), text.blank_to_null(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(12.5, "a b", "a\x01b"), (None, "", None), (None, None, None)]


def test_null_rules_of_checks(spark):
    df = spark.createDataFrame([(None,), (1,), (9,)], "x int")
    got = df.select(checks.allowed_values("x", [1]), checks.forbidden_values("x", [1]), checks.in_range("x", low=2, below=9), checks.not_null(["x"])).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (False, True, True, False), (True, False, True, False)]


def test_split_edges(spark):
    s = Splits("2020-01-01", "2020-02-01", "2020-03-01")
    ms = dt.timedelta(milliseconds=1)
    at = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1) + ms, dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 1) - ms, dt.datetime(2020, 3, 1), None]
    df = spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz")
    assert [r[0] for r in df.select(s.label(F.col("ts"))).collect()] == ["train", "val", "val", "test", None, None]
    assert [r[0] for r in df.select(s.out_of_range(F.col("ts"))).collect()] == [False, False, False, False, True, False]


def test_gate_audit_and_conservation(spark):
    c = contracts.Contract("t", (("k", "long", False), ("v", "string", True)), (contracts.Check("k", "not_null", "quarantine", {"columns": ["k"]}), contracts.Check("v", "allowed_values", "quarantine", {"column": "v", "values": ["a"]})))
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    kept, bad = contracts.gate(df, c)
    assert rows(kept) == [(1, "a")]
    assert {(r["primary_reason"], tuple(r["violation_reasons"])) for r in bad.collect()} == {("k", ("k", "v")), ("v", ("v",))}
    assert dict(rows(contracts.gate_counts(df, c))) == {"total": 3, "quarantined": 2, "gate__k": 1, "gate__v": 2}
    contracts.conserve(3, 1, 2, 0, 0)
    with pytest.raises(AssertionError):
        contracts.conserve(3, 1, 1, 0, 0)
    assert dict(contracts.conformance(df, c)) == {"schema__k": "measured", "schema__v": "pass"}
    with pytest.raises(ValueError):
        contracts.Check("x", "range", "quarantine", {"column": "a"})


def test_keep_latest_does_not_depend_on_partitions(spark):
    data = [("u", "p", 1, "x"), ("u", "p", 2, "z"), ("u", "p", 2, "y"), ("v", "p", 1, "x")]
    df = spark.createDataFrame(data, "u string, p string, ts int, a string")
    for n in (1, 4):
        assert rows(dedup.keep_latest(df.repartition(n), ["u", "p"], "ts", [F.col("a")])) == [("u", "p", 2, "y"), ("v", "p", 1, "x")]
    a, b = (dedup.content_hash(df.repartition(n)).first() for n in (1, 4))
    assert a == b
    assert dedup.content_hash(df.limit(0)).first()["rows"] == 0


def test_kcore_cascade(spark):
    edges = [("U1", "P1"), ("U1", "P2"), ("U2", "P1"), ("U2", "P2"), ("U3", "P2"), ("U3", "P3")]
    core, funnel = kcore(spark.createDataFrame(edges, "user_id string, item_id string"), 2)
    assert rows(core) == edges[:4]
    assert [f["rows"] for f in funnel] == [6, 5, 4, 4] and funnel[-1]["converged"]
    assert rows(kcore(spark.createDataFrame(edges, "user_id string, item_id string"), 9)[0]) == []


def test_kcore_runs_no_pass_that_drops_nothing(spark, monkeypatch):
    from sievework.operators import kcore as module

    names, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or plain(df, name))
    edges = [("U1", "P1"), ("U1", "P2"), ("U2", "P1"), ("U2", "P2"), ("U3", "P2"), ("U3", "P3"), (None, "P1"), ("U1", None)]
    core, funnel = kcore(spark.createDataFrame(edges, "user_id string, item_id string"), 2)
    assert rows(core) == edges[:4] and names.count("kcore") == 3
    assert [(f["iteration"], f["rows"], f["users"], f["items"], f["converged"]) for f in funnel] == [(0, 8, 3, 3, False), (1, 5, 3, 2, False), (2, 4, 2, 2, False), (3, 4, 2, 2, True)]


def test_masked_top_fills_only_the_slots_a_user_needs(spark):
    """Seen items late in the order take no slot; results are those of a plain list."""
    ranked = spark.createDataFrame([(100 - r, r) for r in range(1, 61)], "item_id long, rank long")
    seen = {1: [1, 2, 4, 50, 51, 60], 2: [], 3: list(range(1, 59))}
    pairs = spark.createDataFrame([(u, 100 - r) for u, rs in seen.items() for r in rs], "user_id long, item_id long")
    got = ranking.masked_top(spark.createDataFrame([(u,) for u in seen], "user_id long"), pairs, ranked, 3).collect()
    want = {(u, i + 1): 100 - r for u, rs in seen.items() for i, r in enumerate([r for r in range(1, 61) if r not in rs][:3])}
    assert {(r["user_id"], r["position"]): r["item_id"] for r in got} == want


def test_window_edges(spark):
    at = dt.datetime(2020, 1, 31)
    day = dt.timedelta(days=1)
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate([at, at - 10 * day, at - 30 * day, at + day])], "user_id long, item_id long, ts timestamp_ntz")
    got = {r["window_days"]: r["n_interactions"] for r in features.popularity_grid(df, ["2020-01-31"], [30, 0]).collect()}
    assert got == {30: 2, 0: 3}


def brute(scores, seen, truth):
    order = sorted((i for i in scores if i not in seen), key=lambda i: (-scores[i], i))
    return {g: order.index(g) + 1 for g in truth}


def test_ranks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = list(range(30))
    pop = {i: float(rng.integers(0, 4)) for i in items}
    seen, truth, own, expect, sparse = [], [], [], [], []
    for u in range(25):
        mask = set(rng.choice(items, rng.integers(0, 8), replace=False).tolist())
        gt = rng.choice([i for i in items if i not in mask], 3, replace=False).tolist()
        s = {i: float(rng.integers(1, 3)) for i in rng.choice(items, rng.integers(0, 10), replace=False).tolist()}
        seen += [(u, i) for i in mask]
        truth += [(u, i) for i in gt]
        own += [(u, i, v) for i, v in s.items()]
        expect += [(u, g, r) for g, r in brute(pop, mask, gt).items()]
        sparse += [(u, g, r) for g, r in brute({i: s.get(i, 0.0) for i in items}, mask, gt).items()]
    T = spark.createDataFrame(truth, "user_id long, item_id long")
    S = spark.createDataFrame(seen, "user_id long, item_id long")
    P = spark.createDataFrame(list(pop.items()), "item_id long, score double")
    ranked = ranking.global_rank(P)
    assert rows(ranking.masked_ranks(T, S, ranked)) == sorted(expect, key=str)
    index = spark.createDataFrame([(i, i) for i in items], "item_id long, idx int")
    assert rows(ranking.sparse_ranks(T, S, spark.createDataFrame(own, "user_id long, item_id long, score double"), index)) == sorted(sparse, key=str)
    top = ranking.masked_top(T.select("user_id").distinct(), S, ranked, 5).collect()
    assert len(top) == 25 * 5 and not {(r[0], r[1]) for r in top} & set(seen)


def test_metrics_by_hand(spark):
    m = metrics.per_user(spark.createDataFrame([(1, 1, 1), (1, 2, 15)], "user_id long, item_id long, rank long")).first()
    assert (m["recall_10"], m["recall_20"], m["hit_10"], m["mrr"]) == (0.5, 1.0, 1.0, 1.0)
    assert m["ndcg_10"] == pytest.approx(1 / (1 + 1 / np.log2(3)))
    for values, g in (([1, 2, 3, 4], 0.25), ([0, 0, 0, 1], 0.75)):
        assert metrics.gini(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "item_id long, n long")).first()[0] == pytest.approx(g)


def test_statistics(spark):
    d = np.random.default_rng(1).normal(0.2, 1, 300)
    assert np.array_equal(stats.resampled_means(d, 5, 50), stats.resampled_means(d, 5, 50))
    assert stats.interval(np.array([0.5]), 1) == (0.5, 0.5, 0.5)
    assert stats.p_value(np.ones(99)) == pytest.approx(0.02)
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, label string, p double")
    assert {r["label"]: round(r["q"], 6) for r in stats.q_values(t, ["family"]).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    tests = [{"edge": 0, "delta": -1, "q": 0.01}, {"edge": 5, "delta": 1, "q": 0.01}]
    assert stats.verdict(tests) == {"verdict": "crossover", "n_star": 5}
    with pytest.raises(ValueError):
        stats.check_parameters(1000, 7, 0.05)


def test_models_by_hand(spark):
    train = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "user_id long, item_id long")
    sim = {(r["item_id"], r["neighbour"]): r["similarity"] for r in models.item_knn(train).collect()}
    assert sim[(1, 2)] == pytest.approx(1.0) and sim[(1, 3)] == pytest.approx(1 / np.sqrt(2)) and len(sim) == 6
    with pytest.raises(ValueError):
        models.model("als")
    assert models.als_identity({"rank": 8, "half_life": 3}) == models.als_identity({"rank": 8, "half_life": 9})
    with pytest.raises(ValueError):
        analysis.churn_share(train.limit(0), train)


def test_vectors(spark):
    v = np.random.default_rng(2).normal(size=(40, 8)).astype(np.float32)
    u = vectors.unit(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"))
    got = {}
    for r in vectors.cosine_top(u, u.where("vec_id < 5"), 3, block=2).collect():
        got.setdefault(r["query"], {})[r["position"]] = r["vec_id"]
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        order = [i for i in np.argsort(-(n @ n[q]), kind="stable") if i != q][:3]
        assert [got[q][p] for p in (1, 2, 3)] == order


def test_versions_and_operations(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(i % 30, (i * 7) % 19, dt.datetime(2023, 1, 1) + dt.timedelta(days=i // 2), i % 4 + 1.0) for i in range(540)], "user_id long, item_id long, ts timestamp_ntz, rating double").dropDuplicates(["user_id", "item_id", "ts"])
    first = maintenance.backfill(c, df, "inter", "2023-01-01", "2023-04-01")
    assert first["rows"] == 180
    maintenance.append_month(c, df, "inter", "2023-04")
    with pytest.raises(ValueError):
        maintenance.append_month(c, df, "inter", "2023-04")
    late = df.where("ts >= '2023-04-20' and ts < '2023-05-05'").withColumn("rating", F.lit(5.0))
    m = maintenance.merge_late(c, "inter", late, ["user_id", "item_id", "ts"])
    assert m["rows"] == 240 + 8 and c.read("inter").where("rating = 5.0").count() == 30
    assert maintenance.merge_late(c, "inter", late, ["user_id", "item_id", "ts"])["rows"] == m["rows"]
    maintenance.fragment_month(c, "inter", "2023-02")
    before = c.files("inter").where("path like '%2023-02%'").count()
    assert maintenance.compact(c, "inter")["rows"] == m["rows"]
    assert c.files("inter").where("path like '%2023-02%'").count() == 1 < before
    assert maintenance.compact(c, "inter") is None
    assert c.read("inter", 1).count() == 180
    assert c.expire("inter", 1, protected=(2,)) == [1, 3, 4, 5]
    with pytest.raises(LookupError):
        c.read("inter", 1)
    with pytest.raises(ValueError):
        c.drop("../x")
    assert maintenance.lineage(c, ["inter"]).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": \n')
    df, counts = split_corrupt(read_json_lines(spark, f"file://{tmp_path}/a.json", spark.range(0).selectExpr("id as x").schema))
    assert counts == {"total": 2, "corrupt": 1, "written": 1} and rows(df) == [(1,)] and CORRUPT not in df.columns
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError):
        check_header(spark, f"file://{tmp_path}/b.csv", ("a", "b"))


def test_buckets_and_dense_index(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 99, 100)], "n int")
    assert [r[0] for r in df.select(bucket(F.col("n"), DEEP_EDGES, DEEP)).collect()] == ["0", "1-4", "1-4", "5-9", "50-99", "100+"]
    assert rows(features.dense_index(df.unionAll(df), "n", "i")) == sorted([(n, i) for i, n in enumerate((0, 1, 4, 5, 99, 100))], key=str)


def test_queries_take_the_operators_own_numbers(spark, monkeypatch):
    from inspect import signature

    from sievework.plans import evaluation

    asked = {}

    def spy(module, name):
        f = getattr(module, name)

        def call(*args, **kwargs):
            bound = signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            asked[name] = bound.arguments
            return f(*args, **kwargs)

        monkeypatch.setattr(module, name, call)

    spy(stats, "segment_intervals"), spy(stats, "compare_arms"), spy(models, "als")
    sf = "/root/testdata/sf0.001"
    evaluation.bootstrap_segments(spark, sf), evaluation.compare_arms(spark, sf), evaluation.als_scores(spark, sf)
    for name in ("segment_intervals", "compare_arms"):
        stats.check_parameters(asked[name]["resamples"], asked[name]["seed"], stats.ALPHA)
    assert (asked["als"]["rank"], asked["als"]["iterations"]) == (16, 5)


def test_shared_ranks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, f"c{rng.randrange(3)}", float(rng.choice([0, 0, 1, 1, 2, 3]))) for i in range(60)]
    shares = [(u, f"c{c}", w) for u in range(8) for c, w in enumerate(rng.choice([(0.5, 0.5, 0.0), (0.25, 0.5, 0.25), (1.0, 0.0, 0.0)])) if w]
    seen = [(u, i) for u in range(8) for i in rng.sample(range(60), 7)]
    truth = [(u, i) for u in range(8) for i in rng.sample(range(60), 9) if (u, i) not in seen]
    of = {(u, c): w for u, c, w in shares}
    want = set()
    for u in range(8):
        order = sorted((-round(of.get((u, c), 0) * s, 9), i) for i, c, s in items if (u, i) not in seen)
        want |= {(u, i, n + 1) for n, (_, i) in enumerate(order) if (u, i) in truth}
    got = ranking.shared_ranks(
        spark.createDataFrame(truth, "user_id long, item_id long"), spark.createDataFrame(seen, "user_id long, item_id long"),
        spark.createDataFrame(shares, "user_id long, category string, share double"), spark.createDataFrame(items, "item_id long, category string, score double"), 9,
    )
    assert {tuple(r) for r in got.collect()} == want


def test_popularity_grid_makes_no_row_for_a_row_and_a_cell(spark):
    at = lambda *d: dt.datetime(*d)
    data = [(1, 7, at(2020, 1, 1)), (1, 7, at(2020, 1, 20)), (2, 7, at(2020, 1, 25)), (2, 8, at(2019, 1, 1)), (None, 8, at(2020, 1, 30)), (3, 9, at(2021, 1, 1))]
    grid = features.popularity_grid(spark.createDataFrame(data, "user_id long, item_id long, ts timestamp_ntz"), ["2020-01-31"], [10, 0])
    assert sorted(tuple(r)[1:] for r in grid.collect()) == [(0, 7, 3, 2), (0, 8, 2, 1), (10, 7, 1, 1), (10, 8, 1, 0)]
    assert "Expand" not in grid._jdf.queryExecution().optimizedPlan().toString()
    assert grid._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert grid._jdf.queryExecution().optimizedPlan().toString().index("Generate") < grid._jdf.queryExecution().optimizedPlan().toString().index("Aggregate")


def test_shared_ranks_searches_levels_and_counts_ties_once_for_an_item(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, rng.choice(["a", "b", None]), float(rng.choice([0, 1, 1, 2, 3, 6]))) for i in range(50)]
    shares = [(u, c, w) for u in range(9) for c, w in zip("ab", rng.choice([(1 / 3, 2 / 3), (0.75, 0.25), (0.0, 1.0)]), strict=True)]
    seen = [(u, i) for u in range(9) for i in rng.sample(range(50), 6)]
    truth = [(u, i) for u in range(10) for i in rng.sample(range(50), 15) if (u, i) not in seen]
    of = {(u, c): w for u, c, w in shares}
    want = set()
    for u in range(10):
        order = sorted((-round(of.get((u, c), 0) * s, 9), i) for i, c, s in items if (u, i) not in seen)
        want |= {(u, i, n + 1) for n, (_, i) in enumerate(order) if (u, i) in truth}
    asked, count = [], ranking.count_before
    monkeypatch.setattr(ranking, "count_before", lambda a, b: asked.append(b) or count(a, b))
    frames = [spark.createDataFrame(truth, "user_id long, item_id long"), spark.createDataFrame(seen, "user_id long, item_id long"), spark.createDataFrame(shares, "user_id long, category string, share double"), spark.createDataFrame(items, "item_id long, category string, score double")]
    assert {tuple(r) for r in ranking.shared_ranks(*frames, 9).collect()} == want
    assert asked and all("user_id" not in a.columns and a.count() == a.distinct().count() for a in asked)
