"""Counts that must agree: published against observed ones, identities between layers, and the matrix of checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pass", "measured", "fail")  # from best to worst


@dataclass(frozen=True)
class Identity:
    """The sum of the `left` measures equals that of the `right` ones; a measure with a leading '-' is subtracted."""

    name: str
    left: tuple[str, ...]
    right: tuple[str, ...]
    note: str = ""


@dataclass(frozen=True)
class Edge:
    """Rows of the layer `source` are in the layer `target` or left out for one of `reasons`."""

    source: str
    target: str
    reasons: tuple[str, ...] = ()


def edge_identities(edges: list[Edge]) -> list[Identity]:
    """One identity for each edge of the graph of layers, named `source->target`; the graph must have no cycle."""
    below: dict[str, set[str]] = {}
    for e in edges:
        below.setdefault(e.source, set()).add(e.target)
    rest = set(below) | {t for ts in below.values() for t in ts}
    while rest:
        ends = {n for n in rest if not below.get(n, set()) & rest}
        if not ends:
            raise ValueError(f"layers {sorted(rest)} lie in or above a cycle")
        rest -= ends
    return [Identity(f"{e.source}->{e.target}", (e.source,), (e.target, *e.reasons)) for e in edges]


def identities(measures: DataFrame, rules: list[Identity]) -> DataFrame:
    """Every rule over (name, rows): identity, lhs, rhs, delta, absent, repeated, ok, note.

    One plan: measures meet the rules' terms, which are as few as the rules and therefore broadcast, and are summed by
    rule. A rule holds only if each measure it names is there once: `absent` counts those without a row or with null
    rows only, `repeated` the rows beyond the first of a measure. Measures that no rule names are left alone.
    """
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("two rules of one name")
    for r in rules:
        if any(len({t.lstrip("-") for t in ts}) != len(ts) for ts in (r.left, r.right)):
            raise ValueError(f"{r.name} names a measure twice on one side")
    terms = [(i, r.name, t.lstrip("-"), side, -1 if t.startswith("-") else 1) for i, r in enumerate(rules) for side, ts in enumerate((r.left, r.right)) for t in ts]
    spark = measures.sparkSession
    wanted = spark.createDataFrame(terms, "ordinal int, identity string, name string, side int, sign int")
    heads = spark.createDataFrame([(i, r.name, len({t.lstrip("-") for t in r.left + r.right}), r.note) for i, r in enumerate(rules)], "ordinal int, identity string, wanted int, note string")
    # a measure that a rule names on both sides counts once for absent and repeated
    met = measures.where("rows IS NOT NULL").select("name", F.col("rows").cast("long").alias("rows")).join(F.broadcast(wanted), "name")
    per = met.groupBy("ordinal", "name").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("sign") * F.col("rows"))).alias(c) for s, c in enumerate(("lhs", "rhs"))],
        F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("places"),
    )
    extra = F.ceil(F.col("n") / F.col("places")) - 1
    sums = per.groupBy("ordinal").agg(F.sum("lhs").alias("lhs"), F.sum("rhs").alias("rhs"), F.count(F.lit(1)).alias("met"), F.sum(extra).alias("repeated"))
    out = heads.join(sums, "ordinal", "left")
    lhs, rhs = F.coalesce("lhs", F.lit(0)), F.coalesce("rhs", F.lit(0))
    absent, repeated = F.col("wanted") - F.coalesce("met", F.lit(0)), F.coalesce("repeated", F.lit(0))
    return out.select(
        "identity", lhs.alias("lhs"), rhs.alias("rhs"), (lhs - rhs).alias("delta"), absent.cast("long").alias("absent"),
        repeated.cast("long").alias("repeated"), ((lhs == rhs) & (absent == 0) & (repeated == 0)).alias("ok"), "note",
    )


def violated(found: DataFrame) -> None:
    """Raises with the names and both sides of the identities that don't hold; as few rows as there are rules."""
    bad = found.where("NOT ok").orderBy("identity").collect()
    if bad:
        raise AssertionError("; ".join(f"{r['identity']}: {r['lhs']} against {r['rhs']}, {r['absent']} absent, {r['repeated']} repeated" for r in bad))


def _worst(check: str) -> Column:
    rank = F.max(F.when(F.col("check_id").eqNullSafe(F.lit(check)), F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))))
    return F.try_element_at(F.array(*map(F.lit, STATUSES)), F.nullif(rank, F.lit(0)).cast("int"))


def matrix(ledger: DataFrame, checks: list[str]) -> DataFrame:
    """One row for each table of a ledger (table_name, check_id, status, violations, rows): its checks side by side.

    table_name, rows (the greatest), rows_agree (all rows of the table state the same), one count for each status,
    unlisted (rows of checks beyond the closed set), repeated (rows of a check beyond its first), failing (sorted ids
    of failed checks), then a column for each check: its worst status, null where the table doesn't have it. One
    aggregation by table; a status that isn't known counts for none. Further columns of the ledger are ignored.
    """
    clash = set(checks) & {"table_name", "rows", "rows_agree", "unlisted", "repeated", "failing", *(f"n_{s}" for s in STATUSES)}
    if clash or len(set(checks)) != len(checks):
        raise ValueError(f"checks {sorted(clash)} have the names of the matrix's own columns, or are named twice")
    listed = F.coalesce(F.col("check_id").isin(*checks), F.lit(False))
    return ledger.groupBy("table_name").agg(
        F.max("rows").alias("rows"), F.coalesce(F.min("rows") == F.max("rows"), F.lit(False)).alias("rows_agree"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.count_if(~listed).alias("unlisted"), (F.count("check_id") - F.count_distinct("check_id")).alias("repeated"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("check_id"))))).alias("failing"),
        *[_worst(c).alias(c) for c in checks],
    )


def tallies(ledger: DataFrame) -> DataFrame:
    """kind, status, checks, violations: for each pair, for each kind and for all (null where summed over)."""
    return ledger.rollup("kind", "status").agg(F.count(F.lit(1)).alias("checks"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


def reconcile(published: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Published against observed values by a key that is unique in each: key, published, observed, delta, status.

    status: equal, differs, unobserved (no observed row) or unpublished. Null keys meet each other; a null value equals
    only a null value.
    """
    p = published.select(F.struct(F.col(key)).alias("__p"), F.col(value).alias("published"))
    o = observed.select(F.struct(F.col(key)).alias("__o"), F.col(value).alias("observed"))
    status = (
        F.when(F.col("__o").isNull(), "unobserved").when(F.col("__p").isNull(), "unpublished")
        .when(F.col("published").eqNullSafe(F.col("observed")), "equal").otherwise("differs")
    )
    both = p.join(o, F.col("__p").eqNullSafe(F.col("__o")), "full_outer")
    return both.select(F.coalesce("__p", "__o")[key].alias(key), "published", "observed", (F.col("observed") - F.col("published")).alias("delta"), status.alias("status"))
