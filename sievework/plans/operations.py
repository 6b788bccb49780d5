"""Queries of operations: matrices of checks, identities between layers, differences of records."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import contracts as K
from sievework.operators import dedup, guards, reconcile, records, steps
from sievework.operators.kcore import kcore
from sievework.plans import data as D
from sievework.plans import layers
from sievework.sources import ledger
from sievework.sources.scratch import scratch_dir, written

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ORDERS = K.Contract(
    "silver.orders",
    (("o_orderkey", "long", True), ("o_custkey", "long", True), ("o_orderstatus", "string", True), ("o_totalprice", "double", True)),
    (
        K.Check("keys", "not_null", "quarantine", {"columns": ["o_orderkey", "o_custkey"]}),
        K.Check("status", "allowed_values", "quarantine", {"column": "o_orderstatus", "values": ["F", "O"]}),
        K.Check("price", "range", "quarantine", {"column": "o_totalprice", "low": 1000.0}),
        K.Check("open", "unknown_share", "measure", {"column": "o_orderstatus", "value": "O"}),
        K.Check("customer", "foreign_key", "fail", {"column": "o_custkey", "table": "customer", "ref_column": "c_custkey"}),
    ),
)
PARTS = K.Contract(
    "silver.parts",
    (("p_partkey", "long", True), ("p_name", "string", True), ("p_size", "long", True)),
    (
        K.Check("keys", "not_null", "quarantine", {"columns": ["p_partkey"]}),
        K.Check("size", "range", "quarantine", {"column": "p_size", "low": 5, "high": 45}),
        K.Check("clean", "no_control_chars", "quarantine", {"columns": ["p_name"]}),
        K.Check("dead", "no_all_null", "fail", {"columns": ["p_brand"]}),
    ),
)
AUDITED = {"lineitem": (layers.LINES, "part"), "orders": (ORDERS, "customer"), "part": (PARTS, None)}
CHECKS = ["keys", "flag", "status", "quantity", "discount", "clean", "dead", "open", "part", "customer", "price"]  # not size

_KINDS = "(VALUES " + ", ".join(f"('{t}', '{c.id}', '{c.kind}')" for t, (k, _) in AUDITED.items() for c in k.checks) + ") k(table_name, check_id, kind)"
_LEDGER = f"""ledger AS (SELECT l.*, kind FROM (SELECT 'lineitem' AS table_name, * FROM ({layers.SQL["audit"]})
 UNION ALL SELECT 'orders', u.check_id, CASE WHEN u.check_id = 'open' THEN 'measured' WHEN u.v = 0 THEN 'pass' ELSE 'fail' END, u.v, n
 FROM (SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL OR o_custkey IS NULL) AS keys, count(*) FILTER (coalesce(o_orderstatus NOT IN ('F', 'O'), true)) AS status,
 count(*) FILTER (o_totalprice < 1000) AS price, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS customer FROM orders)
 UNPIVOT (v FOR check_id IN (keys, status, price, open, customer)) u
 UNION ALL SELECT 'part', u.check_id, CASE WHEN u.v = 0 THEN 'pass' ELSE 'fail' END, u.v, n
 FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS keys, count(*) FILTER (p_size < 5 OR p_size > 45) AS size,
 count(*) FILTER (regexp_matches(p_name, '[\\x00-\\x1F\\x7F]')) AS clean, (count(p_brand) = 0)::BIGINT AS dead FROM part)
 UNPIVOT (v FOR check_id IN (keys, size, clean, dead)) u) l JOIN {_KINDS} USING (table_name, check_id))"""


def _ledger(spark, sf) -> DataFrame:
    """The audits of all contracts as one ledger: table_name, check_id, kind, status, violations, rows."""
    out = []
    for name, (contract, ref) in AUDITED.items():
        kinds = F.create_map(*[F.lit(x) for c in contract.checks for x in (c.id, c.kind)])
        found = K.audit(D.table(spark, sf, name), contract, {ref: D.table(spark, sf, ref)} if ref else None)
        out.append(found.select(F.lit(name).alias("table_name"), "check_id", kinds[F.col("check_id")].alias("kind"), "status", "violations", "rows"))
    return reduce(DataFrame.unionByName, out)


@query("dq_matrix", f"""WITH {_LEDGER} SELECT table_name, max("rows") AS "rows", min("rows") = max("rows") AS rows_agree, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in reconcile.STATUSES)},
 count(*) FILTER (check_id NOT IN ({", ".join(f"'{c}'" for c in CHECKS)})) AS unlisted, count(*) - count(DISTINCT check_id) AS repeated, coalesce(string_agg(CASE WHEN status = 'fail' THEN check_id END, ',' ORDER BY check_id), '') AS failing,
 {", ".join(f"max(CASE WHEN check_id = '{c}' THEN status END) AS " + '"' + c + '"' for c in CHECKS)} FROM ledger GROUP BY 1""")
def dq_matrix(spark, sf):
    return reconcile.matrix(_ledger(spark, sf), CHECKS)


@query("dq_tallies", f"WITH {_LEDGER} SELECT kind, status, count(*) AS checks, CAST(sum(violations) AS BIGINT) AS violations FROM ledger GROUP BY ROLLUP (kind, status)")
def dq_tallies(spark, sf):
    return reconcile.tallies(_ledger(spark, sf))


REASONS = [c.id for c in layers.LINES.gating()]
RULES = [
    *reconcile.edge_identities([
        reconcile.Edge("lines", "raw", ("orphans",)),
        reconcile.Edge("raw", "interactions", ("superseded",)),
        reconcile.Edge("interactions", "core", ("pruned",)),
        reconcile.Edge("lines", "kept", tuple(f"quarantined:{r}" for r in REASONS)),
    ]),
    reconcile.Identity("quarantine is whole", ("quarantine",), tuple(f"quarantined:{r}" for r in REASONS), "the first reasons account for the quarantine"),
    reconcile.Identity("funnel begins at interactions", ("funnel_first",), ("interactions",)),
    reconcile.Identity("funnel ends at the core", ("funnel_last",), ("core",)),
    reconcile.Identity("audited rows", ("audit:lineitem",), ("lines",), "the audited table is that of the layers"),
]


def _measures(spark, sf) -> DataFrame:
    """(name, rows): each measure is counted from its own table, none as the difference of two others."""
    lines, orders = D.table(spark, sf, "lineitem"), D.table(spark, sf, "orders")
    raw, inter = D.raw(spark, sf), written(D.interactions(spark, sf).select("user_id", "item_id"), "layer")
    core, funnel = kcore(inter, 20)
    marked = K.annotate(lines, layers.LINES)
    gated = marked.agg(
        F.count_if(F.size("violation_reasons") == 0).alias("kept"), F.count_if(F.size("violation_reasons") > 0).alias("quarantine"),
        *[F.count_if((F.size("violation_reasons") > 0) & (F.try_element_at("violation_reasons", F.lit(1)) == r)).alias(f"quarantined:{r}") for r in REASONS],
    )
    again = raw.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
    whole = {
        "lines": lines, "raw": raw, "interactions": inter, "core": core,
        "orphans": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "pruned": inter.join(core, ["user_id", "item_id"], "left_anti"),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in whole.items()]
    audited = K.audit(lines, layers.LINES, {"part": D.table(spark, sf, "part")}).where("check_id = 'keys'").select(F.lit("audit:lineitem").alias("name"), "rows")
    told = spark.createDataFrame([("funnel_first", funnel[0]["rows"]), ("funnel_last", funnel[-1]["rows"])], "name string, rows long")
    return reduce(DataFrame.unionByName, [*counted, again.toDF("rows").select(F.lit("superseded").alias("name"), "rows"), gated.unpivot([], gated.columns, "name", "rows"), audited, told])


_COUNTS = f"""lines AS (SELECT count(*) AS n FROM lineitem), r AS (SELECT count(*) AS n FROM ({layers.SQL["interactions_projection"]})), e AS MATERIALIZED ({layers.SQL["degrees"]}), i AS (SELECT count(*) AS n FROM e),
 k AS MATERIALIZED ({layers.SQL["kcore_edges"]}), c AS (SELECT count(*) AS n FROM k), f AS ({layers.SQL["kcore_funnel"]}), q AS (SELECT count(*) AS n FROM ({layers.SQL["gate_quarantine"]})),
 again AS (SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM ({layers.SQL["interactions_projection"]}) GROUP BY user_id, item_id)), pruned AS (SELECT count(*) AS n FROM e ANTI JOIN k USING (user_id, item_id)),
 reasons AS (SELECT CAST(sum("rows") AS BIGINT) AS n FROM ({layers.SQL["primary_reasons"]})), orphans AS (SELECT count(*) AS n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey)"""


@query("layer_identities", f"""WITH {_COUNTS}, both_ AS (SELECT 'lines->raw' AS identity, lines.n AS lhs, r.n + orphans.n AS rhs, '' AS note FROM lines, r, orphans
 UNION ALL SELECT 'raw->interactions', r.n, i.n + again.n, '' FROM r, i, again UNION ALL SELECT 'interactions->core', i.n, c.n + pruned.n, '' FROM i, c, pruned
 UNION ALL SELECT 'lines->kept', lines.n, (SELECT count(*) FROM ({layers.SQL["gate_kept"]})) + reasons.n, '' FROM lines, reasons UNION ALL SELECT 'quarantine is whole', q.n, reasons.n, 'the first reasons account for the quarantine' FROM q, reasons
 UNION ALL SELECT 'funnel begins at interactions', (SELECT "rows" FROM f WHERE iteration = 0), n, '' FROM i UNION ALL SELECT 'funnel ends at the core', (SELECT "rows" FROM f ORDER BY iteration DESC LIMIT 1), n, '' FROM c
 UNION ALL SELECT 'audited rows', (SELECT "rows" FROM ({layers.SQL["audit"]}) WHERE check_id = 'keys'), n, 'the audited table is that of the layers' FROM lines)
 SELECT identity, lhs, rhs, lhs - rhs AS delta, CAST(0 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS repeated, lhs = rhs AS ok, note FROM both_""")
def layer_identities(spark, sf):
    return reconcile.identities(written(_measures(spark, sf), "measures"), RULES)


@query("reconcile_months", f"""WITH {D.INTER}, p AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM raw GROUP BY 1), o AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM inter GROUP BY 1)
 SELECT month, p.n AS published, o.n AS observed, o.n - p.n AS delta, CASE WHEN o.n IS NULL THEN 'unobserved' WHEN p.n IS NULL THEN 'unpublished' WHEN o.n = p.n THEN 'equal' ELSE 'differs' END AS status FROM p FULL JOIN o USING (month)""")
def reconcile_months(spark, sf):
    """Monthly rows as they came in against those of the deduplicated layer."""
    by = [df.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")) for df in (D.raw(spark, sf), D.interactions(spark, sf))]
    return reconcile.reconcile(*by, "month", "n")


CUTS = ("1999-01-01", "2001-01-01")


def _profiles(raw: DataFrame, end: str) -> DataFrame:
    """One JSON record for each user of the rows before `end`; ratings that a user never gave are left out."""
    rows = raw.where(F.col("ts") < F.lit(end).cast("timestamp"))
    ratings = [F.nullif(F.count_if(F.col("rating") == r), F.lit(0)).alias(f"r{r}") for r in range(1, 6)]
    per = rows.groupBy("user_id").agg(
        F.struct(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day"), F.max("orderkey").alias("orderkey")).alias("last"), F.count(F.lit(1)).alias("lines"),
        F.struct(*ratings).alias("ratings"), F.array_sort(F.collect_set(F.year("ts"))).alias("years"),
    )
    return per.select("user_id", F.to_json(F.struct("last", "lines", "ratings", "years")).alias("record"))


def _profile_sql(name: str, end: str) -> str:
    rows = f"(SELECT * FROM raw WHERE ts < TIMESTAMP '{end}')"
    return f"""{name}_r AS (SELECT user_id, map(list('r' || rating ORDER BY rating), list(n ORDER BY rating)) AS ratings FROM (SELECT user_id, rating, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1),
 {name}_p AS (SELECT user_id, {{'day': strftime(max(ts), '%Y-%m-%d'), 'orderkey': max(orderkey)}} AS last, count(*) AS lines, list(DISTINCT year(ts) ORDER BY year(ts)) AS years FROM {rows} GROUP BY 1),
 {name} AS (SELECT user_id, to_json({{'last': last, 'lines': lines, 'ratings': ratings, 'years': years}}) AS record FROM {name}_p JOIN {name}_r USING (user_id)),
 {name}_t AS (SELECT user_id, t.fullkey AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS kind, json_array_length(t.value) AS size, CAST(t.value AS VARCHAR) AS value FROM {name}, json_tree(record) t)"""


@query("record_diff", f"""WITH {D.RAW}, {_profile_sql("a", CUTS[0])}, {_profile_sql("b", CUTS[1])},
 j AS MATERIALIZED (SELECT user_id, path, a.value AS old, b.value AS new, a.kind AS old_type, b.kind AS new_type, coalesce(a.kind = b.kind AND (a.kind = 'object' OR a.kind = 'array' AND a.size = b.size), false) AS walk FROM a_t a FULL JOIN b_t b USING (user_id, path))
 SELECT user_id, path, old, new, old_type, new_type, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j
 WHERE NOT walk AND (old_type IS DISTINCT FROM new_type OR old IS DISTINCT FROM new)
 AND NOT EXISTS (FROM j up WHERE up.user_id = j.user_id AND NOT up.walk AND (starts_with(j.path, up.path || '.') OR starts_with(j.path, up.path || '[')))""")
def record_diff(spark, sf):
    """What changed in each user's profile between two days, as paths."""
    raw = D.raw(spark, sf)
    return records.diff(*[_profiles(raw, c) for c in CUTS], ["user_id"], "record")


@query("step_lineage", f"""WITH {D.INTER}, n AS (SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM raw) AS joined,
 (SELECT count(*) FROM inter) AS latest, (SELECT count(*) FROM inter WHERE rating >= 4) AS liked, (SELECT count(DISTINCT item_id) FROM inter WHERE rating >= 4) AS items)
 SELECT CAST(o AS BIGINT) AS ordinal, step, source, a AS rows_in, b AS rows_out, a - b AS left_out, true AS has_bytes, true AS has_files FROM (
 SELECT 0 AS o, 'raw' AS step, 'lineitem' AS source, lines AS a, joined AS b FROM n UNION ALL SELECT 0, 'raw', 'orders', orders, joined FROM n UNION ALL SELECT 1, 'latest', 'raw', joined, latest FROM n
 UNION ALL SELECT 2, 'liked', 'latest', latest, liked FROM n UNION ALL SELECT 3, 'items', 'liked', liked, items FROM n)""")
def step_lineage(spark, sf):
    """Four steps that write their tables and record rows, bytes and files as they run."""
    rec = steps.Recorder(spark, f"{scratch_dir(spark)}/steps-{uuid.uuid4().hex}", "run")
    line, order = (rec.source(D.table(spark, sf, t), t) for t in ("lineitem", "orders"))
    both = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    raw = rec.step(
        both.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("ts"), F.ceil(F.col("l_quantity") / 10).alias("rating"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("linenumber")),
        "raw", ["lineitem", "orders"],
    )
    latest = rec.step(dedup.keep_latest(raw, D.KEYS, "ts", [F.col("orderkey"), F.col("linenumber")]), "latest", ["raw"])
    liked = rec.step(latest.where("rating >= 4"), "liked", ["latest"])
    rec.step(liked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "items", ["liked"])
    found = steps.lineage(ledger.read(spark, rec.ledger))
    return found.select("ordinal", "step", "source", "rows_in", "rows_out", "left_out", (F.col("bytes") > 0).alias("has_bytes"), (F.col("files") > 0).alias("has_files"))


_SIDES = "a AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, item_id, rating, orderkey, linenumber, ts FROM raw), b AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, item_id, rating, orderkey, linenumber, ts FROM inter)"


@query("unequal_months", f"""WITH {D.INTER}, {_SIDES}, off AS (SELECT DISTINCT month FROM (FROM a EXCEPT ALL FROM b) UNION SELECT DISTINCT month FROM (FROM b EXCEPT ALL FROM a))
 SELECT month, (SELECT count(*) FROM a WHERE a.month = off.month) AS rows_a, (SELECT count(*) FROM b WHERE b.month = off.month) AS rows_b FROM off""")
def unequal_months(spark, sf):
    """Months whose rows differ between the raw and the deduplicated layer, found by digests without a row-wise join."""
    a, b = (df.withColumn("month", F.date_format("ts", "yyyy-MM")) for df in (D.raw(spark, sf), D.interactions(spark, sf)))
    return guards.unequal(a, b, ["month"])
