"""Queries of audits as runs, histories of chosen users, text coverage and writes."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import functions as F

from sievework.functions import hashing, times
from sievework.functions import text as X
from sievework.functions.times import MAIN
from sievework.operators import audit_runs, features, histories
from sievework.operators.kcore import kcore
from sievework.plans import data as D
from sievework.plans import layers, operations
from sievework.sources import contract_files, files, ledger
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


def _fresh(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _contracts(spark) -> dict:
    """The contracts of all audited tables, by way of their files."""
    path = _fresh(spark, "contracts")
    texts = [(t, contract_files.render(replace(c, name=t))) for t, (c, _) in operations.AUDITED.items()]
    spark.createDataFrame(texts, "table string, value string").write.partitionBy("table").text(path)
    return contract_files.load(spark, path, "*.txt")


#: Declared columns that the tables don't hold as declared: p_size is an int there.
_SCHEMA = ", ".join(f"('{t}', 'schema__{n}', '{'fail' if n == 'p_size' else 'pass' if z else 'measured'}', {int(n == 'p_size')})" for t, (c, _) in operations.AUDITED.items() for n, _k, z in c.columns)
_RUN = f"""{operations._LEDGER}, run AS (SELECT table_name, check_id, kind, status, violations, "rows" FROM ledger
 UNION ALL SELECT t, i, 'schema', s, v, NULL FROM (VALUES {_SCHEMA}) x(t, i, s, v))"""


@query("audit_run", f"""WITH {_RUN} SELECT 'r1' AS run_id, table_name, CAST(1 AS BIGINT) AS version, check_id, kind, status, CAST(violations AS BIGINT) AS violations, CAST("rows" AS BIGINT) AS "rows",
 (SELECT CAST(max(status = 'fail') AS INTEGER) FROM run) AS code FROM run""")
def audit_run(spark, sf):
    """All contracts, read from their files, over their tables; the run twice, as its rows stand in the ledger."""
    path, at = _fresh(spark, "audits"), datetime(2024, 1, 1, tzinfo=UTC)
    for _ in range(2):
        out = audit_runs.run(spark, _contracts(spark), lambda t: D.table(spark, sf, t), path, "r1", at)
    rows = ledger.read(spark, path).withColumn("code", F.lit(out.code))
    return rows.select("run_id", "table_name", "version", "check_id", "kind", "status", "violations", "rows", "code")


REQUIRED = list(operations.AUDITED)


def _runs(spark, sf) -> str:
    """A ledger of four runs: two whole ones, one without a table, one with a table's checks twice."""
    path = _fresh(spark, "runs")
    rows = written(operations._ledger(spark, sf), "audit")
    stamped = lambda df, day: df.withColumn("run_ts", F.lit(f"2024-01-0{day}").cast("timestamp"))
    ledger.append(stamped(rows, 1), path, "a", 0)
    ledger.append(stamped(rows, 2), path, "b", 0)
    ledger.append(stamped(rows.where("table_name <> 'part'"), 3), path, "c", 0)
    ledger.append(stamped(rows, 4), path, "d", 0)
    ledger.append(stamped(rows.where("table_name = 'orders'"), 4), path, "d", 1)
    return path


@query("audit_coverage", f"""WITH {operations._LEDGER}, runs AS (SELECT r.*, l.* FROM ledger l CROSS JOIN (VALUES ('a', 1), ('b', 1), ('c', 1), ('d', 1), ('d', 2)) r(run_id, batch)
 WHERE NOT (run_id = 'c' AND table_name = 'part') AND (batch = 1 OR table_name = 'orders')), per AS (SELECT run_id, table_name, check_id, count(*) AS n FROM runs GROUP BY ALL)
 SELECT run_id, '2024-01-0' || (1 + strpos('abcd', run_id) - 1) AS day, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (VALUES ('lineitem'), ('orders'), ('part')) w(t) WHERE t NOT IN (SELECT table_name FROM per p WHERE p.run_id = per.run_id)), '') AS missing,
 count(*) FILTER (n > 1) AS repeated, count(DISTINCT table_name) = 3 AND max(n) = 1 AS complete FROM per GROUP BY run_id""")
def audit_coverage(spark, sf):
    found = audit_runs.coverage(ledger.read(spark, _runs(spark, sf)), REQUIRED)
    return found.select("run_id", F.date_format("run_ts", "yyyy-MM-dd").alias("day"), F.array_join("missing", ",").alias("missing"), "repeated", "complete")


@query("latest_audit", f"""WITH {operations._LEDGER} SELECT 'b' AS run_id, table_name, check_id, status, CAST(violations AS BIGINT) AS violations, CAST("rows" AS BIGINT) AS "rows" FROM ledger""")
def latest_audit(spark, sf):
    """The latest run that is whole, though later ones are partial or doubled."""
    return audit_runs.latest_complete(ledger.read(spark, _runs(spark, sf)), REQUIRED).select("run_id", "table_name", "check_id", "status", "violations", "rows")


SALT = b"a salt that only this query has"
_INNER, _OUTER = (p.hex() for p in hashing.pads(SALT))
_PSEUDONYM = f"substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(user_id AS VARCHAR))))), 1, 12)"


@query("user_histories", f"""WITH {D.INTER} SELECT {_PSEUDONYM} AS shopper, user_id, item_id, strftime(ts, '%Y-%m-%d') AS day, rating, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS position
 FROM inter WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def user_histories(spark, sf):
    """The histories of one segment's customers under pseudonyms."""
    users = D.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    found = histories.histories(D.interactions(spark, sf), users)
    return found.select(hashing.pseudonym(F.col("user_id"), SALT).alias("shopper"), "user_id", "item_id", layers.day("ts").alias("day"), "rating", "position")


@query("catalog_texts", """WITH o AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part)
 SELECT item_id, position, doc_id IS NOT NULL AS found, coalesce(length(text), 0) AS n_chars FROM o LEFT JOIN documents ON doc_id = item_id""")
def catalog_texts(spark, sf):
    """Texts in the order of the catalog's index, written as files that ascend with it and read back."""
    texts = D.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    order = features.dense_index(D.items(spark, sf).select("item_id"), "item_id", "position")
    path = _fresh(spark, "texts")
    files.write_in_order(histories.in_catalog_order(texts, order, "item_id", "position"), path, ("position",))
    return spark.read.parquet(path).select("item_id", F.col("position").cast("long").alias("position"), "found", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


CUTOFF = "1993-06-30"


@query("text_coverage", f"""WITH t AS (SELECT l_partkey AS item_id, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS tag FROM lineitem WHERE l_shipdate <= TIMESTAMP '{CUTOFF}'),
 i AS (SELECT p_partkey AS item_id, p_type, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS text, p_partkey NOT IN (SELECT item_id FROM t WHERE tag IS NOT NULL) AS bare FROM part),
 m AS (SELECT 'zero_tag' AS measure, count(*) FILTER (bare) AS n, count(*) AS "rows" FROM i UNION ALL SELECT 'empty_genres', count(*) FILTER (coalesce(trim(p_type), '') = ''), count(*) FROM i
 UNION ALL SELECT 'empty_text', count(*) FILTER (bare AND coalesce(trim(text), '') = ''), count(*) FROM i UNION ALL SELECT 'empty_tag_rows', count(*) FILTER (tag IS NULL), count(*) FROM t)
 SELECT measure, n, "rows", CASE WHEN "rows" = 0 THEN 0.0 ELSE n / "rows" END AS share FROM m""")
def text_coverage(spark, sf):
    """Flags of returned lines are the tags, N is none; parts of a small size have no text of their own."""
    part = D.table(spark, sf, "part")
    items = part.select(F.col("p_partkey").alias("item_id"), X.split_genres(F.replace("p_type", F.lit(" "), F.lit("|"))).alias("genres"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("title"))
    tags = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.replace("l_returnflag", F.lit("N"), F.lit(" ")).alias("tag"), F.col("l_shipdate").alias("ts"))
    return features.text_coverage(items, tags, CUTOFF, X.recipe(F.col("title")))


_VARIANTS = layers._core_sql(20, 8).replace(f"WITH {D.INTER}", f"WITH {D.labelled(MAIN)}")


@query("core_variants", _VARIANTS + ", v AS (SELECT 'all' AS variant, * FROM lab UNION ALL SELECT 'core', lab.* FROM lab SEMI JOIN e8 USING (user_id, item_id)) "
 "SELECT variant, item_id, count(*) FILTER (split = 'train') AS n_train_support, epoch_ms(max(ts) FILTER (split = 'train')) AS last_train_ms, epoch_ms(min(ts)) AS first_seen_ms FROM v GROUP BY ALL")
def core_variants(spark, sf):
    """Item statistics of all interactions and of their core, by the same function."""
    inter = written(D.interactions(spark, sf), "inter")
    both = [features.item_train_stats(df, MAIN).withColumn("variant", F.lit(v)) for v, df in (("all", inter), ("core", kcore(inter.select("user_id", "item_id", "ts"), 20)[0]))]
    return both[0].unionByName(both[1])


@query("event_details", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at_ms, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS at_s FROM events")
def event_details(spark, sf):
    """Values of a map by key, and times from whole milliseconds and seconds."""
    e = D.table(spark, sf, "events")
    held, millis = X.details(F.col("props")), F.unix_millis(F.col("ts").cast("timestamp"))
    at = lambda c, unit: times.from_epoch(c, unit)
    return e.select("event_id", X.detail(held, "k").alias("k"), X.detail(held, "absent").alias("absent"), F.date_format(at(millis, "milliseconds"), "yyyy-MM-dd HH:mm:ss.SSS").alias("at_ms"), F.date_format(at(F.floor(millis / 1000), "seconds"), "yyyy-MM-dd HH:mm:ss").alias("at_s"))


@query("balanced_write", f"WITH {D.RAW} SELECT strftime(ts, '%Y') AS year, count(*) AS n, count(DISTINCT user_id) AS users FROM raw GROUP BY 1")
def balanced_write(spark, sf):
    path = _fresh(spark, "balanced")
    files.write_balanced(D.raw(spark, sf).withColumn("year", F.date_format("ts", "yyyy")), path, ("year",))
    return spark.read.parquet(path).groupBy(F.col("year").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("late_updates")
def late_updates(spark, sf):
    """Rows of the late window that a replay sends again, about a fiftieth of those not held out."""
    cols = ["user_id", "item_id", "ts"]
    hit = times.late_update(cols, F.col("ts"), "1997-01-01", "1998-01-01", 1000, 10, 20)
    return D.interactions(spark, sf).where(hit).select("user_id", "item_id", layers.day("ts").alias("day"), "rating")
