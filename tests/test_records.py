import json

from pyspark.sql import functions as F

from sievework.operators import records

SCHEMA = "id long, run string, record string, path string"


def brute(a, b, path="$"):
    """(path, change) by plain recursion."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in a | b:
            at = path + "." + (k if k.isidentifier() and k.isascii() else '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"')
            out += [(at, "removed")] if k not in b else [(at, "added")] if k not in a else brute(a[k], b[k], at)
        return out
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [d for i, (x, y) in enumerate(zip(a, b)) for d in brute(x, y, f"{path}[{i}]")]
    numbers = [isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)]
    if all(numbers) and a == b:
        return [(path, "type")] if isinstance(a, int) != isinstance(b, int) else []
    return [(path, "changed")] if type(a) is not type(b) or a != b else []


def found(spark, pairs):
    rows = [[(i, "r", p[s], "clash") for i, p in enumerate(pairs)] for s in (0, 1)]
    return records.diff(*[spark.createDataFrame(r, SCHEMA) for r in rows], ["id", "run"], "record")


def test_trees_as_brute_force(spark):
    trees = [
        ({"a": 1, "b": [1, 2, {"c": None}]}, {"a": 1.0, "b": [1, 3, {"c": 0}]}),
        ({"a": {"x": 1}}, {"a": [1]}), ({"a": [1, 2]}, {"a": [1, 2, 3]}), ({}, {}), ([], {}), ({"a": []}, {"a": []}),
        ({"a": True}, {"a": 1}), ({"a": "1"}, {"a": 1}), ({"a": None}, {}), ({}, {"a": None}), ({"a": None}, {"a": None}),
        ({"x.y": 1, "x": {"y": 1}, 'q"\\': 2}, {"x.y": 2, "x": {"y": 2}, 'q"\\': 3}), ({"é": 1}, {"é": 2}),
        ({"k": [[{"d": [1, [2, [3, {"e": 4}]]]}]]}, {"k": [[{"d": [1, [2, [3, {"e": 5}]]]}]]}),
        ({"a": 0.1, "b": 1e300, "c": 2**60 + 1}, {"a": 0.10, "b": 1e300, "c": 2**60}), ({"t": "x" * 200_000}, {"t": "x" * 200_000 + "y"}),
    ]
    got = found(spark, [(json.dumps(a), json.dumps(b, indent=1)) for a, b in trees])
    want = sorted((i, *d) for i, (a, b) in enumerate(trees) for d in brute(a, b))
    assert sorted((r["id"], r["path"], r["change"]) for r in got.collect()) == want
    row = got.where("id = 0 AND path = '$.b[1]'").first()
    assert (row["old"], row["new"], row["old_type"], row["new_type"]) == ("2", "3", "integer", "integer")


def test_nulls_text_that_is_no_json_and_empty_tables(spark):
    pairs = [(None, '{"a":1}'), ('{"a":1}', None), (None, None), ("bad", "bad"), ("bad", '"bad"'), ('{"a":1,"a":2}', '{"a":1}'), ("1e2", "100"), ("1.50", "1.5")]
    got = sorted((r["id"], r["path"], r["change"]) for r in found(spark, pairs).collect())
    assert got == [(0, "$", "added"), (1, "$", "removed"), (4, "$", "changed"), (5, "$", "changed"), (6, "$", "type")]
    empty = spark.createDataFrame([], SCHEMA)
    assert records.diff(empty, empty, ["id"], "record").count() == 0
    one = spark.createDataFrame([(None, "r", '{"a":1}', "")], SCHEMA)
    assert records.diff(one, one.withColumn("record", F.lit('{"a":2}')), ["id"], "record").select("path", "change").collect() == [("$.a", "changed")]
