import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import hashing, times
from sievework.functions import text as X
from sievework.operators import audit_runs, features, histories, ranking
from sievework.operators import contracts as K
from sievework.sources import contract_files, files, ledger

USERS = K.Contract(
    "users", (("id", "long", True), ("state", "string", True)),
    (
        K.Check("id", "not_null", "quarantine", {"columns": ["id"]}), K.Check("state", "allowed_values", "fail", {"column": "state", "values": ["on", "off"]}),
        K.Check("age", "range", "measure", {"column": "age", "low": 0, "below": 150}), K.Check("dead", "no_all_null", "fail", {"columns": ["state"]}),
        K.Check("team", "foreign_key", "fail", {"column": "team", "table": "teams", "ref_column": "id"}),
    ), 3,
)


def test_contract_files_are_read_strictly(spark, tmp_path):
    text = contract_files.render(USERS)
    assert contract_files.parse(text) == USERS
    folder = tmp_path / "contracts"
    folder.mkdir()
    (folder / "users.json").write_text(text + "\n")
    (folder / "plain.json").write_text(json.dumps({"table": "a", "checks": []}))
    (folder / "notes.txt").write_text("no contract")
    assert contract_files.load(spark, str(folder)) == {"a": K.Contract("a", (), ()), "users": USERS}
    (folder / "again.json").write_text(text)
    with pytest.raises(ValueError, match="users.*more than once"):
        contract_files.load(spark, str(folder))

    def check(**kw):
        return json.dumps({"table": "t", "checks": [{"id": "c", "kind": "range", "action": "fail", "column": "x", "low": 1} | kw]})

    contract_files.parse(check())
    bad = {
        "{": "Expecting", "[]": "list", json.dumps({"table": "t"}): "checks", json.dumps({"table": "t", "checks": [], "chekcs": []}): "chekcs",
        json.dumps({"table": "t", "checks": [], "version": True}): "version", check(kind="rnage"): "kind", check(action="drop"): "action", check(hihg=3): "hihg",
        check(column=""): "column must be", check(high=0): "holds nothing", check(low=None): "needs a limit",
        json.dumps({"table": "t", "checks": [{"id": "c", "kind": "not_null", "action": "fail", "columns": []}]}): "list with values",
        json.dumps({"table": "t", "checks": [{"id": "c", "kind": "no_all_null", "action": "quarantine", "columns": ["x"]}]}): "whole table",
        json.dumps({"table": "t", "checks": [{"id": "c", "kind": "not_null", "action": "fail", "columns": ["x"]}] * 2}): "more than once",
        json.dumps({"table": "t", "columns": [{"name": "x", "kind": "long"}], "checks": []}): "columns",
    }
    for text, message in bad.items():
        with pytest.raises(ValueError, match=message):
            contract_files.parse(text)


def test_audit_runs_and_their_coverage(spark, tmp_path):
    path = f"file://{tmp_path}/audits"
    teams = spark.createDataFrame([(1,)], "id long")
    good = spark.createDataFrame([(1, "on", 30, 1), (2, "off", None, None)], "id long, state string, age int, team long")
    bad = spark.createDataFrame([(1, "on", 30, 1), (None, "gone", 200, 9)], "id long, state string, age int, team long")
    contracts = {"users": USERS, "teams": K.Contract("teams", (), (K.Check("id", "not_null", "fail", {"columns": ["id"]}),))}

    def go(run, day, **tables):
        return audit_runs.run(spark, contracts, tables.get, path, run, datetime(2024, 1, day), skip_missing=run == "some")

    assert go("none", 1, teams=teams).code == 2 and "users" in go("none", 1, teams=teams).problem
    assert "to refer to" in audit_runs.run(spark, {"users": USERS}, {"users": good}.get, path, "none").problem
    assert "no columns ['age']" in go("none", 1, users=good.drop("age"), teams=teams).problem
    assert not (tmp_path / "audits").exists()
    out = go("good", 2, users=good, teams=teams)
    assert (out.code, out.statuses, out.skipped) == (0, {"pass": 7, "measured": 1}, ())
    for _ in range(2):
        out = go("bad", 3, users=bad, teams=teams)
        assert (out.code, out.statuses) == (1, {"pass": 4, "fail": 3, "measured": 1})
    out = go("some", 4, teams=teams)
    assert (out.code, out.skipped) == (0, ("users",))
    rows = ledger.read(spark, path)
    of = {(r["run_id"], r["check_id"]): (r["kind"], r["violations"], r["rows"], r["version"]) for r in rows.where("table_name = 'users'").collect()}
    assert of["bad", "state"] == ("allowed_values", 1, 2, 3) and of["bad", "team"] == ("foreign_key", 1, 2, 3) and of["good", "schema__id"] == ("schema", 0, None, 3)

    twice = rows.unionByName(rows.where("run_id = 'good'").withColumns({"run_id": F.lit("twice"), "run_ts": F.lit("2024-02-01").cast("timestamp")}))
    twice = twice.unionByName(twice.where("run_id = 'twice' AND check_id = 'dead'"))
    got = {r["run_id"]: (r["missing"], r["repeated"], r["complete"]) for r in audit_runs.coverage(twice, ["users", "teams", "users"]).collect()}
    assert got == {"good": ([], 0, True), "bad": ([], 0, True), "some": (["users"], 0, False), "twice": ([], 1, False)}
    run_of = lambda df: {r["run_id"] for r in df.select("run_id").collect()}
    assert run_of(audit_runs.latest_complete(twice, ["users", "teams"])) == {"bad"}
    assert run_of(audit_runs.latest_complete(twice, ["teams"])) == {"some"}
    assert run_of(audit_runs.latest_complete(twice, ["users"], pinned="good")) == {"good"}
    assert run_of(audit_runs.latest_complete(twice, ["users"], pinned="some")) == set()
    assert run_of(audit_runs.latest_complete(twice.where("false"), ["users"])) == set()


def test_pseudonyms_are_hmacs(spark):
    values = ["", "1", "ü" * 70, None, "x" * 500]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for key in (b"", b"k", b"\xff" * 64, b"long" * 40):
        got = {r["i"]: (r["h"], r["p"]) for r in df.select("i", hashing.hmac_sha256(F.col("v"), key).alias("h"), hashing.pseudonym(F.col("v"), key).alias("p")).collect()}
        want = {i: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for i, v in enumerate(values)}
        assert got == {i: (h, h and h[:12]) for i, h in want.items()}
    assert "Python" not in df.select(hashing.pseudonym(F.col("v"), b"k"))._jdf.queryExecution().executedPlan().toString()


def test_histories_with_a_hot_user_ties_and_nulls(spark):
    rows = [("hot", f"i{i % 7}", f"2024-01-{1 + i % 28:02d}", 9) for i in range(300)] + [("a", "x", "2024-01-02", 1), ("a", "y", "2024-01-02", 2), ("a", "z", None, 3), (None, "x", "2024-01-01", 4), ("other", "x", "2024-01-01", 5)]
    inter = spark.createDataFrame(rows, "user_id string, item_id string, day string, position int").withColumn("ts", F.col("day").cast("timestamp_ntz")).drop("position")
    users = spark.createDataFrame([("hot",), ("a",), ("a",), (None,), ("unseen",)], "user_id string")
    got = histories.histories(inter, users).collect()
    want = sorted([r[:3] for r in rows if r[0] in ("hot", "a")], key=lambda r: (r[0], r[2] or "", r[1]))
    assert [(r["user_id"], r["item_id"], r["day"]) for r in sorted(got, key=lambda r: (r["user_id"], r["position"]))] == want
    assert sorted(r["position"] for r in got if r["user_id"] == "hot") == list(range(1, 301))
    assert histories.histories(inter, users.where("false")).count() == 0


def test_texts_in_catalog_order(spark, tmp_path):
    texts = spark.createDataFrame([("b", "B" * 100_000), ("a", None), ("q", "unlisted"), (None, "n")], "item_id string, text string")
    order = spark.createDataFrame([("b", 0), ("c", 1), ("a", 2)], "item_id string, position int")
    path = str(tmp_path / "texts")
    files.write_in_order(histories.in_catalog_order(texts, order, "item_id", "position"), path, ("position",), 1)
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name()).collect()
    ordered = sorted(stored, key=lambda r: r["file"])
    assert [(r["item_id"], r["found"], len(r["text"] or "")) for r in ordered] == [("b", True, 100_000), ("c", False, 0), ("a", True, 0)]
    assert len({r["file"] for r in stored}) == 3
    with pytest.raises(ValueError, match="texts"):
        histories.in_catalog_order(texts.unionByName(texts), order, "item_id", "position")
    with pytest.raises(ValueError, match="order"):
        histories.in_catalog_order(texts, order.unionByName(order), "item_id", "position")


def test_text_coverage(spark):
    items = spark.createDataFrame([("a", ["g"], "A"), ("b", [], ""), ("c", None, None), ("d", ["g"], " ")], "item_id string, genres array<string>, title string")
    tags = spark.createDataFrame([("a", " x ", "2024-01-01"), ("a", " ", "2024-01-01"), ("b", None, "2024-01-01"), ("d", "y", "2024-03-01"), ("gone", "", "2024-01-01"), ("c", "z", "2024-01-31")], "item_id string, tag string, day string")
    tags = tags.withColumn("ts", F.col("day").cast("timestamp_ntz"))
    of = lambda i, t: {r["measure"]: (r["n"], r["rows"], r["share"]) for r in features.text_coverage(i, t, "2024-01-31", X.recipe(F.col("title"))).collect()}
    assert of(items, tags) == {"zero_tag": (2, 4, 0.5), "empty_genres": (2, 4, 0.5), "empty_text": (2, 4, 0.5), "empty_tag_rows": (3, 5, 0.6)}
    assert of(items.where("false"), tags.where("false")) == dict.fromkeys(("zero_tag", "empty_genres", "empty_text", "empty_tag_rows"), (0, 0, 0.0))


def test_small_functions(spark):
    df = spark.createDataFrame([('{"k": 1, "s": "t", "o": {"x": [2]}}', 1_700_000_000_123), ("{broken", -1), (None, None)], "j string, n long")
    got = df.select(*[X.detail(X.details(F.col("j")), k).alias(k) for k in ("k", "s", "o", "gone")], F.unix_millis(times.from_epoch(F.col("n"), "milliseconds")).alias("ms"), F.unix_seconds(times.from_epoch(F.col("n"), "seconds")).alias("sec")).collect()
    assert tuple(got[0]) == ("1", "t", '{"x":[2]}', None, 1_700_000_000_123, 1_700_000_000_123) and tuple(got[1]) == (None, None, None, None, -1, -1) and set(got[2]) == {None}
    with pytest.raises(ValueError, match="days"):
        times.from_epoch(F.col("n"), "days")


def test_late_updates_meet_no_held_out_row(spark):
    cols = ["user_id", "item_id", "ts"]
    df = spark.range(20_000).select((F.col("id") % 97).alias("user_id"), F.col("id").alias("item_id"), F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    window = ("2024-01-03", "2024-01-12")
    hit = df.where(times.late_update(cols, F.col("ts"), *window, 10, 3, 2))
    late = df.where(times.half_open(F.col("ts"), *window))
    free = late.where(~times.hash_share(cols, 10, 3))
    assert hit.where(times.hash_share(cols, 10, 3)).isEmpty() and hit.exceptAll(free).isEmpty()
    assert 0.17 < hit.count() / free.count() < 0.23 and 0.67 < free.count() / late.count() < 0.73


def test_balanced_write_keeps_rows_and_cuts_hot_partitions(spark, tmp_path):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300KB")
    try:
        files.write_balanced(df, str(tmp_path / "by"), ("part",))
        files.write_balanced(df, str(tmp_path / "whole"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.parquet(str(tmp_path / "by")).select(F.col("part").cast("long"), "v")
    assert back.exceptAll(df).isEmpty() and back.count() == 40_000
    assert len(list((tmp_path / "by" / "part=7").glob("*.parquet"))) > 1 and len(list((tmp_path / "by" / "part=0").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 40_000


def test_shared_ranks_refuses_scores_that_round_together(spark):
    truth = spark.createDataFrame([("u", 1)], "user_id string, item_id long")
    shares = spark.createDataFrame([("u", "c", 0.0001)], "user_id string, category string, share double")
    items = spark.createDataFrame([(1, "c", 100), (2, "c", 101), (3, "c", 5)], "item_id long, category string, score long")
    with pytest.raises(ValueError, match="fall together"):
        ranking.shared_ranks(truth, truth.where("false"), shares, items, 3)
    assert ranking.shared_ranks(truth, truth.where("false"), shares, items, 9).first()["rank"] == 2
    clash = spark.createDataFrame([(1, "A", 5.0), (2, "A|5.0", 3.0), (3, "A", 5.0), (4, "A|5.0", 3.0)], "item_id long, category string, score double")
    both = spark.createDataFrame([("u", "A", 0.5), ("u", "A|5.0", 0.5)], "user_id string, category string, share double")
    want = spark.createDataFrame([("u", i) for i in (1, 2, 3, 4)], "user_id string, item_id long")
    assert {r["item_id"]: r["rank"] for r in ranking.shared_ranks(want, want.where("false"), both, clash, 9).collect()} == {1: 1, 3: 2, 2: 3, 4: 4}
