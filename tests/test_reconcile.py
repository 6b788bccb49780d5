import pytest

from sievework.operators import reconcile as R

EDGES = [R.Edge("raw", "silver", ("twice", "bad")), R.Edge("silver", "gold", ("pruned",))]
RULES = [*R.edge_identities(EDGES), R.Identity("net", ("raw", "-bad"), ("silver", "twice")), R.Identity("own", ("raw",), ("raw",))]
GOOD = {"raw": 100, "silver": 90, "twice": 7, "bad": 3, "gold": 50, "pruned": 40, "unnamed": 5}


def measures(spark, rows):
    return spark.createDataFrame([(n, v, "x") for n, v in rows], "name string, rows long, identity string")


def test_identities_name_what_is_broken(spark):
    whole = R.identities(measures(spark, GOOD.items()), RULES)
    assert {r["identity"]: (r["lhs"], r["rhs"], r["ok"]) for r in whole.collect()} == {
        "raw->silver": (100, 100, True), "silver->gold": (90, 90, True), "net": (97, 97, True), "own": (100, 100, True)
    }
    R.violated(whole)
    lost = measures(spark, (GOOD | {"gold": 49}).items())
    with pytest.raises(AssertionError, match="^silver->gold: 90 against 89, 0 absent, 0 repeated$"):
        R.violated(R.identities(lost, RULES))


def test_absent_null_and_repeated_measures_break_a_rule(spark):
    rows = [(n, v) for n, v in GOOD.items() if n != "pruned"] + [("pruned", None), ("twice", 0), (None, 4)]
    got = {r["identity"]: (r["absent"], r["repeated"], r["ok"]) for r in R.identities(measures(spark, rows), RULES).collect()}
    assert got == {"raw->silver": (0, 1, False), "silver->gold": (1, 0, False), "net": (0, 1, False), "own": (0, 0, True)}
    none = R.identities(measures(spark, []), RULES)
    assert [(r["lhs"], r["rhs"], r["ok"]) for r in none.collect()] == [(0, 0, False)] * 4
    with pytest.raises(ValueError, match="cycle"):
        R.edge_identities([*EDGES, R.Edge("gold", "silver")])
    with pytest.raises(ValueError, match="two rules"):
        R.identities(none.select("identity"), [RULES[0], RULES[0]])
    with pytest.raises(ValueError, match="twice on one side"):
        R.identities(none.select("identity"), [R.Identity("x", ("raw", "-raw"), ())])


def test_matrix_keeps_all_rows_in_its_counts(spark):
    rows = [
        ("a", "keys", "pass", 0, 9), ("a", "size", "fail", 2, 9), ("a", "size", "pass", 0, 9), ("a", "other", "measured", 1, 9),
        ("b", "keys", "measured", 0, 4), ("b", "size", None, 0, 5), (None, "keys", "fail", 1, 1), ("c", None, "odd", None, None),
    ]
    ledger = spark.createDataFrame([(*r, "kind", 0) for r in rows], "table_name string, check_id string, status string, violations long, rows long, kind string, keys int")
    got = {r["table_name"]: r.asDict() for r in R.matrix(ledger, ["keys", "size"]).collect()}
    want = ("rows", "rows_agree", "n_pass", "n_measured", "n_fail", "unlisted", "repeated", "failing", "keys", "size")
    assert {t: tuple(r[c] for c in want) for t, r in got.items()} == {
        "a": (9, True, 2, 1, 1, 1, 1, "size", "pass", "fail"), "b": (5, False, 0, 1, 0, 0, 0, "", "measured", None),
        None: (1, True, 0, 0, 1, 0, 0, "keys", "fail", None), "c": (None, False, 0, 0, 0, 1, 0, "", None, None),
    }
    assert R.matrix(ledger.limit(0), ["keys"]).count() == 0
    with pytest.raises(ValueError, match="failing"):
        R.matrix(ledger, ["failing"])
    all_ = {(r["kind"], r["status"]): r["checks"] for r in R.tallies(ledger.where("status IS NOT NULL")).collect()}
    assert all_[("kind", "pass")] == 2 and all_[("kind", None)] == 7 and all_[(None, None)] == 7


def test_reconcile_published_with_observed(spark):
    schema = "table string, rows long, published int"
    p = spark.createDataFrame([("a", 10, 0), ("b", 5, 0), ("c", None, 0), (None, 1, 0)], schema)
    o = spark.createDataFrame([("a", 10, 0), ("b", 7, 0), ("c", None, 0), ("d", 2, 0), (None, 2, 0)], schema)
    got = {r["table"]: (r["delta"], r["status"]) for r in R.reconcile(p, o, "table", "rows").collect()}
    assert got == {"a": (0, "equal"), "b": (2, "differs"), "c": (None, "equal"), "d": (None, "unpublished"), None: (1, "differs")}
    assert {r["status"] for r in R.reconcile(p, o.limit(0), "table", "rows").collect()} == {"unobserved"}
