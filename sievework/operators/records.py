"""Differences of nested records, walked level by level as variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.scratch import written

CHANGES = ("added", "removed", "changed", "type")
_NUMBERS = ("integer", "decimal", "double")


def _kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer, decimal or double."""
    s = F.schema_of_variant(v)
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "decimal"}
    return reduce(lambda out, p: F.when(s.startswith(p[0]), p[1]).otherwise(out), named.items(), F.lit("double"))


def _step(key: Column) -> Column:
    """`.key`, quoted where the key isn't a plain name, so that different keys never give one path."""
    inner = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit("."), F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), inner, F.lit('"'))))


def _rated(df: DataFrame) -> DataFrame:
    """With kinds, and whether the pair of nodes is walked on: two objects, or two arrays of one length."""
    df = df.withColumns({f"{s}_kind": F.when(F.col(f"has_{s}"), F.when(F.col(f"{s}").isNull(), "null").otherwise(_kind(F.col(s)))) for s in "ab"})
    sizes = [F.size(F.try_variant_get(F.col(s), "$", "array<variant>")) for s in "ab"]
    both = (F.col("a_kind") == F.col("b_kind")) & ~F.col("raw")
    walk = both & ((F.col("a_kind") == "object") | ((F.col("a_kind") == "array") & (sizes[0] == sizes[1])))
    return df.withColumn("walk", F.coalesce(walk, F.lit(False)))


def _children(df: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes below a pair, side by side: no join, as both maps or arrays lie in the row."""
    df = df.withColumns({f"{s}_map": F.when(F.col("a_kind") == "object", F.try_variant_get(F.col(s), "$", "map<string,variant>")) for s in "ab"})
    df = df.withColumns({f"{s}_list": F.when(F.col("a_kind") == "array", F.try_variant_get(F.col(s), "$", "array<variant>")) for s in "ab"})
    a, b, p = F.col("a_map"), F.col("b_map"), F.col("path")

    def field(key):
        return F.struct(F.concat(p, _step(key)).alias("path"), a[key].alias("a"), b[key].alias("b"), F.map_contains_key(a, key).alias("has_a"), F.map_contains_key(b, key).alias("has_b"))

    def place(pair, i):
        at = F.concat(p, F.lit("["), i.cast("string"), F.lit("]"))
        return F.struct(at.alias("path"), pair["a_list"].alias("a"), pair["b_list"].alias("b"), F.lit(True).alias("has_a"), F.lit(True).alias("has_b"))

    below = F.when(F.col("a_kind") == "object", F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), field)).otherwise(F.transform(F.arrays_zip("a_list", "b_list"), place))
    return df.select(*ids, F.lit(False).alias("raw"), F.explode(below).alias("n")).select(*ids, "raw", "n.*")


def _leaves(df: DataFrame, ids: list[str]) -> DataFrame:
    """Pairs that aren't walked on and aren't alike."""
    texts = [F.to_json(F.coalesce(F.col(s), F.parse_json(F.lit("null")))) for s in "ab"]
    numbers = [F.try_variant_get(F.col(s), "$", "double") for s in "ab"]
    ak, bk = F.col("a_kind"), F.col("b_kind")
    floating = (ak == "double") | (bk == "double")
    numeric = ak.isin(*_NUMBERS) & bk.isin(*_NUMBERS)
    same = F.when(numeric & floating, numbers[0] == numbers[1]).when(numeric | (ak == bk), texts[0] == texts[1]).otherwise(False)
    drift = (ak == "integer") != (bk == "integer")
    change = (
        F.when(~F.col("has_a"), "added").when(~F.col("has_b"), "removed")
        .when(~same | F.col("raw"), "changed").when(numeric & drift, "type")
    )
    out = df.where(~F.col("walk")).withColumn("change", change).where("change IS NOT NULL")
    return out.select(*ids, "path", *[F.when(F.col(f"has_{s}"), t).alias(n) for s, t, n in zip("ab", texts, ("old", "new"))], F.col("a_kind").alias("old_type"), F.col("b_kind").alias("new_type"), "change")


def diff(old: DataFrame, new: DataFrame, ids: list[str], record: str) -> DataFrame:
    """Where the JSON trees in `record` of two tables differ: ids, path, old, new, old_type, new_type, change.

    Objects meet by key, arrays of one length by place; other pairs are compared whole, as are trees that only one side
    has. `change` is added, removed, changed, or type for equal numbers of which one is an integer and the other isn't.
    Numbers with an exponent are compared as doubles, others exactly; integers beyond 64 bits count as decimals.

    Each level is a narrow pass: only the first step joins. Records whose texts are equal are never parsed, and one more
    pass is made for each level of the deepest tree that differs. A null record is the same as a missing row. A text that
    isn't JSON, or repeats a key, is shown as a string and is `changed` against any other text. Null ids meet each other.
    ids must be unique in each table; further columns are ignored, whatever they are called.
    """
    sides = [d.where(F.col(record).isNotNull()).select(F.struct(*ids).alias("__id"), F.col(record).alias(f"__{s}")).alias(s) for d, s in ((old, "a"), (new, "b"))]
    pairs = sides[0].join(sides[1], F.col("a.__id").eqNullSafe(F.col("b.__id")), "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    parsed = [F.try_parse_json(F.col(f"__{s}")) for s in "ab"]
    bad = [p.isNull() & F.col(f"__{s}").isNotNull() for p, s in zip(parsed, "ab")]
    level = pairs.select(
        F.coalesce("a.__id", "b.__id").alias("__id"), (bad[0] | bad[1]).alias("raw"), F.lit("$").alias("path"),
        *[F.coalesce(p, F.col(f"__{s}").cast("variant")).alias(s) for p, s in zip(parsed, "ab")],
        F.col("__a").isNotNull().alias("has_a"), F.col("__b").isNotNull().alias("has_b"),
    )
    found = []
    while True:
        nodes = written(_rated(level), "record_level")
        found.append(_leaves(nodes, ["__id"]))
        walked = nodes.where("walk")
        if walked.isEmpty():
            break
        level = _children(walked, ["__id"])
    return reduce(DataFrame.unionByName, found).select("__id.*", "path", "old", "new", "old_type", "new_type", "change")
