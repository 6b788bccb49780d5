"""Queries of the data layers: projections, contracts, dedup, pruning, features, ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions.times import MAIN, age_days, half_open
from sievework.operators import contracts as K
from sievework.operators import dedup, features
from sievework.operators.kcore import kcore
from sievework.plans import data as D
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


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


LINES = K.Contract(
    "silver.lines",
    (("l_orderkey", "long", True), ("l_partkey", "long", True), ("l_quantity", "double", True), ("l_returnflag", "string", True)),
    (
        K.Check("keys", "not_null", "quarantine", {"columns": ["l_orderkey", "l_partkey"]}),
        K.Check("flag", "allowed_values", "quarantine", {"column": "l_returnflag", "values": ["A", "N", "R"]}),
        K.Check("status", "forbidden_values", "quarantine", {"column": "l_linestatus", "values": ["X"]}),
        K.Check("quantity", "range", "quarantine", {"column": "l_quantity", "low": 2.0, "below": 49.0}),
        K.Check("discount", "range", "quarantine", {"column": "l_discount", "high": 0.08}),
        K.Check("clean", "no_control_chars", "quarantine", {"columns": ["l_returnflag", "l_linestatus"]}),
        K.Check("dead", "no_all_null", "fail", {"columns": ["l_tax", "l_shipdate"]}),
        K.Check("open", "unknown_share", "measure", {"column": "l_linestatus", "value": "O"}),
        K.Check("part", "foreign_key", "fail", {"column": "l_partkey", "table": "part", "ref_column": "p_partkey"}),
    ),
)

_BAD = """marked AS (SELECT *, l_orderkey IS NULL OR l_partkey IS NULL AS keys, coalesce(l_returnflag NOT IN ('A','N','R'), true) AS flag,
 coalesce(l_linestatus IN ('X'), false) AS status, coalesce(l_quantity < 2 OR l_quantity >= 49, false) AS quantity, coalesce(l_discount > 0.08, false) AS discount,
 regexp_matches(coalesce(l_returnflag, ''), '[\\x00-\\x1F\\x7F]') OR regexp_matches(coalesce(l_linestatus, ''), '[\\x00-\\x1F\\x7F]') AS clean FROM lineitem)"""
_ANY = "(keys OR flag OR status OR quantity OR discount OR clean)"
_FIRST = "CASE WHEN keys THEN 'keys' WHEN flag THEN 'flag' WHEN status THEN 'status' WHEN quantity THEN 'quantity' WHEN discount THEN 'discount' ELSE 'clean' END"


@query("items_projection", """SELECT p_partkey AS item_id, trim(regexp_replace(p_name, '[\\x00-\\x1F\\x7F]', ' ', 'g')) AS title, lower(p_brand) AS brand, 'brand' AS brand_source,
 CASE WHEN regexp_matches(trim(CAST(p_size AS VARCHAR)), '^\\$?\\d+(\\.\\d+)?$') THEN CAST(p_size AS DOUBLE) END AS price_usd,
 CASE WHEN regexp_matches(trim(p_type), '^\\$?\\d+(\\.\\d+)?$') THEN CAST(p_type AS DOUBLE) END AS price_unparsed FROM part""")
def items_projection(spark, sf):
    brand, source = X.first_named(("brand", F.col("p_brand")), ("maker", F.col("p_type")))
    p = D.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item_id"), X.control_to_space(F.col("p_name")).alias("title"), brand.alias("brand"), source.alias("brand_source"), X.parse_price(F.col("p_size").cast("string")).alias("price_usd"), X.parse_price(F.col("p_type")).alias("price_unparsed"))


@query("interactions_projection", f"WITH {D.RAW} SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day, rating, orderkey, linenumber FROM raw")
def interactions_projection(spark, sf):
    return D.raw(spark, sf).select("user_id", "item_id", day("ts").alias("day"), "rating", "orderkey", "linenumber")


@query("gate_kept", f"WITH {_BAD} SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM marked WHERE NOT {_ANY}")
def gate_kept(spark, sf):
    return K.gate(D.table(spark, sf, "lineitem"), LINES)[0].select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("gate_quarantine", f"""WITH {_BAD} SELECT l_orderkey, l_linenumber, {_FIRST} AS primary_reason,
 array_to_string(list_filter([CASE WHEN keys THEN 'keys' END, CASE WHEN flag THEN 'flag' END, CASE WHEN status THEN 'status' END, CASE WHEN quantity THEN 'quantity' END, CASE WHEN discount THEN 'discount' END, CASE WHEN clean THEN 'clean' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM marked WHERE {_ANY}""")
def gate_quarantine(spark, sf):
    return K.gate(D.table(spark, sf, "lineitem"), LINES)[1].select("l_orderkey", "l_linenumber", "primary_reason", F.concat_ws(",", "violation_reasons").alias("reasons"))


@query("gate_counts", f"""WITH {_BAD} SELECT 'total' AS check_id, count(*) AS rows FROM marked UNION ALL SELECT 'quarantined', count(*) FILTER ({_ANY}) FROM marked
 UNION ALL SELECT 'gate__keys', count(*) FILTER (keys) FROM marked UNION ALL SELECT 'gate__flag', count(*) FILTER (flag) FROM marked UNION ALL SELECT 'gate__status', count(*) FILTER (status) FROM marked
 UNION ALL SELECT 'gate__quantity', count(*) FILTER (quantity) FROM marked UNION ALL SELECT 'gate__discount', count(*) FILTER (discount) FROM marked UNION ALL SELECT 'gate__clean', count(*) FILTER (clean) FROM marked""")
def gate_counts(spark, sf):
    return K.gate_counts(D.table(spark, sf, "lineitem"), LINES)


@query("primary_reasons", f"WITH {_BAD} SELECT {_FIRST} AS reason, count(*) AS rows FROM marked WHERE {_ANY} GROUP BY 1")
def primary_reasons(spark, sf):
    return K.reason_counts(K.gate(D.table(spark, sf, "lineitem"), LINES)[1], True)


@query("any_reasons", f"WITH {_BAD} SELECT 'quantity' AS reason, count(*) AS rows FROM marked WHERE quantity HAVING count(*) > 0 UNION ALL SELECT 'discount', count(*) FROM marked WHERE discount HAVING count(*) > 0 UNION ALL SELECT 'flag', count(*) FROM marked WHERE flag HAVING count(*) > 0 UNION ALL SELECT 'keys', count(*) FROM marked WHERE keys HAVING count(*) > 0")
def any_reasons(spark, sf):
    return K.reason_counts(K.gate(D.table(spark, sf, "lineitem"), LINES)[1], False)


@query("audit", f"""WITH {_BAD}, v AS (SELECT count(*) AS rows, count(*) FILTER (keys) AS keys, count(*) FILTER (flag) AS flag, count(*) FILTER (status) AS status, count(*) FILTER (quantity) AS quantity,
 count(*) FILTER (discount) AS discount, count(*) FILTER (clean) AS clean, (count(l_tax) = 0)::BIGINT + (count(l_shipdate) = 0)::BIGINT AS dead, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part)) AS part, count(l_partkey) AS fk FROM marked),
 t AS (SELECT 'keys' AS check_id, keys AS violations, rows FROM v UNION ALL SELECT 'flag', flag, rows FROM v UNION ALL SELECT 'status', status, rows FROM v UNION ALL SELECT 'quantity', quantity, rows FROM v
 UNION ALL SELECT 'discount', discount, rows FROM v UNION ALL SELECT 'clean', clean, rows FROM v UNION ALL SELECT 'dead', dead, rows FROM v UNION ALL SELECT 'open', open, rows FROM v UNION ALL SELECT 'part', part, fk FROM v)
 SELECT check_id, CASE WHEN check_id = 'open' THEN 'measured' WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status, violations, rows FROM t""")
def audit(spark, sf):
    return K.audit(D.table(spark, sf, "lineitem"), LINES, {"part": D.table(spark, sf, "part")})


@query("exact_dedup", "SELECT l_partkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def exact_dedup(spark, sf):
    return dedup.drop_exact(D.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("quantity")))


@query("keep_latest", f"WITH {D.INTER} SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day, rating, orderkey, linenumber FROM inter")
def keep_latest(spark, sf):
    return D.interactions(spark, sf).select("user_id", "item_id", day("ts").alias("day"), "rating", "orderkey", "linenumber")


@query("tie_groups", f"WITH {D.RAW} SELECT user_id, item_id, count(*) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, item_id) AS last FROM raw) WHERE ts = last GROUP BY 1, 2 HAVING count(*) > 1")
def tie_groups(spark, sf):
    return dedup.tie_groups(D.raw(spark, sf, n := D.parts(spark, sf)), D.KEYS, "ts", n)


@query("waterfall", f"""WITH {D.INTER}, {_BAD} SELECT 'superseded' AS reason, (SELECT count(*) FROM raw) - (SELECT count(*) FROM inter) AS rows UNION ALL SELECT 'kept', (SELECT count(*) FROM inter)
 UNION ALL SELECT 'gate:' || {_FIRST}, count(*) FROM marked WHERE {_ANY} GROUP BY 1 UNION ALL SELECT 'gate:passed', count(*) FROM marked WHERE NOT {_ANY}""")
def waterfall(spark, sf):
    raw, kept = D.raw(spark, sf), D.interactions(spark, sf)
    counts = raw.agg(F.count(F.lit(1)).alias("a")).join(kept.agg(F.count(F.lit(1)).alias("kept")))
    base = counts.select(F.explode(F.array(F.struct(F.lit("superseded").alias("reason"), (F.col("a") - F.col("kept")).alias("rows")), F.struct(F.lit("kept").alias("reason"), F.col("kept").alias("rows")))).alias("x")).select("x.*")
    good, bad = K.gate(D.table(spark, sf, "lineitem"), LINES)
    gates = K.reason_counts(bad, True).select(F.concat(F.lit("gate:"), "reason").alias("reason"), "rows")
    return base.unionByName(gates).unionByName(good.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("gate:passed").alias("reason"), "rows"))


@query("content_difference", """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 40), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)
 SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def content_difference(spark, sf):
    rows = D.table(spark, sf, "lineitem")
    return dedup.difference(rows.where("l_quantity < 40").select("l_orderkey", "l_linenumber"), rows.where("l_quantity > 10").select("l_orderkey", "l_linenumber"), D.parts(spark, sf))


@query("content_hash")
def content_hash(spark, sf):
    return dedup.content_hash(D.table(spark, sf, "lineitem")).select("rows", F.col("hash").cast("string").alias("hash"))


def _core_sql(k: int, passes: int) -> str:
    steps = ["e0 AS MATERIALIZED (SELECT user_id, item_id FROM inter)"]
    for i in range(passes):
        steps.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE user_id IN (SELECT user_id FROM e{i} GROUP BY 1 HAVING count(*) >= {k}) AND item_id IN (SELECT item_id FROM e{i} GROUP BY 1 HAVING count(*) >= {k}))")
    return f"WITH {D.INTER}, " + ", ".join(steps)


@query("kcore_edges", _core_sql(20, 8) + " SELECT user_id, item_id FROM e8")
def kcore_edges(spark, sf):
    return kcore(D.interactions(spark, sf).select("user_id", "item_id"), 20)[0]


@query("kcore_funnel", _core_sql(20, 8) + ", f AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS iteration, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM e{i}" for i in range(9)) + ") SELECT * FROM f WHERE iteration <= 1 + (SELECT min(iteration) FROM f WHERE rows = (SELECT min(rows) FROM f)) ")
def kcore_funnel(spark, sf):
    funnel = kcore(D.interactions(spark, sf).select("user_id", "item_id"), 20)[1]
    return spark.createDataFrame([(f["iteration"], f["rows"], f["users"], f["items"]) for f in funnel], "iteration long, rows long, users long, items long")


@query("degrees", f"WITH {D.INTER} SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS user_degree, count(*) OVER (PARTITION BY item_id) AS item_degree FROM inter")
def degrees(spark, sf):
    return features.with_degrees(D.interactions(spark, sf).select("user_id", "item_id")).select("user_id", "item_id", "user_degree", "item_degree")


@query("user_stats", f"""WITH {D.labelled(MAIN)} SELECT user_id, count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
 strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, date_diff('day', min(ts), max(ts)) AS tenure_days FROM lab GROUP BY 1""")
def user_stats(spark, sf):
    return features.user_stats(D.interactions(spark, sf), MAIN).select("user_id", "n_total", "n_train", "n_val", "n_test", day("first_ts").alias("first_day"), day("last_ts").alias("last_day"), F.col("tenure_days").cast("long").alias("tenure_days"))


@query("popularity_grid", f"""WITH {D.INTER}, cells AS (SELECT * FROM (VALUES (TIMESTAMP '1999-12-31'), (TIMESTAMP '2000-06-30')) a(as_of), (VALUES (30), (90), (365), (0)) w(window_days))
 SELECT strftime(as_of, '%Y-%m-%d') AS as_of, CAST(window_days AS BIGINT) AS window_days, item_id, count(*) AS n_interactions, count(DISTINCT user_id) AS n_unique_users FROM inter JOIN cells ON ts <= as_of AND (window_days = 0 OR ts > as_of - to_days(window_days)) GROUP BY ALL""")
def popularity_grid(spark, sf):
    g = features.popularity_grid(D.interactions(spark, sf), ["1999-12-31", "2000-06-30"], [30, 90, 365, 0])
    return g.select(day("as_of").alias("as_of"), F.col("window_days").cast("long").alias("window_days"), "item_id", "n_interactions", "n_unique_users")


@query("item_train_stats", f"WITH {D.labelled(MAIN)} SELECT item_id, count(*) FILTER (split = 'train') AS n_train_support, epoch_ms(max(ts) FILTER (split = 'train')) AS last_train_ms, epoch_ms(min(ts)) AS first_seen_ms FROM lab GROUP BY 1")
def item_train_stats(spark, sf):
    return features.item_train_stats(D.interactions(spark, sf), MAIN)


@query("volume_by_month", f"""WITH {D.INTER}, m AS (SELECT date_trunc('month', ts) AS period, count(*) AS n, count(DISTINCT user_id) AS users FROM inter GROUP BY 1)
 SELECT strftime(period, '%Y-%m-%d') AS period, n, users, CAST(sum(n) OVER (ORDER BY period) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY period) / sum(n) OVER (), 6) AS share FROM m""")
def volume_by_month(spark, sf):
    return features.volume(D.interactions(spark, sf)).select(day("period").alias("period"), "n", "users", "running", F.round("share", 6).alias("share"))


@query("day_slices", f"WITH {D.INTER} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM inter GROUP BY 1")
def day_slices(spark, sf):
    return features.day_slices(D.interactions(spark, sf)).select(day("day").alias("day"), "n")


@query("top_tags", """WITH t AS (SELECT source AS item_id, doc_id AS user_id, trim(lower(unnest(string_split(text, ' ')))) AS tag FROM documents), w AS (SELECT item_id, tag, count(DISTINCT user_id) AS weight FROM t WHERE tag <> '' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, tag) AS rank FROM w) SELECT item_id, string_agg(tag, ' ' ORDER BY rank) AS tags FROM r WHERE rank <= 10 GROUP BY 1""")
def top_tags(spark, sf):
    return features.top_listed_tags(D.tag_lists(spark, sf)).select("item_id", F.array_join("tags", " ").alias("tags"))


@query("item_text", """SELECT p_partkey AS item_id, concat_ws(' ', nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ''), nullif(lower(p_brand), ''), nullif(p_type, '')) AS text FROM part""")
def item_text(spark, sf):
    p = D.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item_id"), X.recipe(X.one_line(F.col("p_name")), F.lower("p_brand"), F.col("p_type")).alias("text"))


@query("strip_urls", r"""SELECT page_id, trim(regexp_replace(regexp_replace('see ' || url || ' now', 'https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages""")
def strip_urls(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.strip_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("clean"))


@query("genre_split", "SELECT p_partkey AS item_id, CAST(len(string_split(replace(p_type, ' ', '|'), '|')) AS BIGINT) AS n, string_split(replace(p_type, ' ', '|'), '|')[1] AS first FROM part")
def genre_split(spark, sf):
    g = X.split_genres(F.replace("p_type", F.lit(" "), F.lit("|")))
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.size(g).cast("long").alias("n"), F.element_at(g, 1).alias("first"))


@query("json_details", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_details(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("catalog_semi", f"WITH {D.labelled(MAIN)} SELECT p_partkey AS item_id, p_brand AS brand FROM part WHERE p_partkey IN (SELECT item_id FROM val)")
def catalog_semi(spark, sf):
    val = D.part_of(D.interactions(spark, sf), MAIN, "val").select("item_id")
    return D.items(spark, sf).join(val, "item_id", "left_semi").select("item_id", "brand")


@query("catalog_anti", f"WITH {D.labelled(MAIN)} SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM val)")
def catalog_anti(spark, sf):
    val = D.part_of(D.interactions(spark, sf), MAIN, "val").select("item_id")
    return D.items(spark, sf).join(val, "item_id", "left_anti").select("item_id")


@query("dictionary_pairs", f"""WITH {D.INTER}, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM inter)), i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM inter))
 SELECT user_idx, item_idx FROM inter JOIN u USING (user_id) JOIN i USING (item_id)""")
def dictionary_pairs(spark, sf):
    inter = D.interactions(spark, sf)
    users, items = features.dense_index(inter, "user_id", "user_idx"), features.dense_index(inter, "item_id", "item_idx")
    return inter.join(users, "user_id").join(items, "item_id").select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"))


@query("category_codes", "WITH f AS (SELECT p_type AS category, min(p_partkey) AS first FROM part WHERE p_type IS NOT NULL GROUP BY 1) SELECT category, row_number() OVER (ORDER BY first) AS code FROM f")
def category_codes(spark, sf):
    return features.category_codes(D.items(spark, sf)).select("category", F.col("code").cast("long").alias("code"))


@query("pair_ages", f"WITH {D.labelled(MAIN)} SELECT user_id, item_id, round((epoch_us(TIMESTAMP '1999-12-31') - epoch_us(ts)) / 86400000000.0, 6) AS age_days FROM train")
def pair_ages(spark, sf):
    return D.part_of(D.interactions(spark, sf), MAIN, "train").select("user_id", "item_id", F.round(age_days(F.col("ts"), "1999-12-31"), 6).alias("age_days"))


@query("month_slice", f"WITH {D.INTER} SELECT user_id, item_id, strftime(ts, '%Y-%m-%d') AS day FROM inter WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1996-04-01'")
def month_slice(spark, sf):
    return D.interactions(spark, sf).where(half_open(F.col("ts"), "1996-03-01", "1996-04-01")).select("user_id", "item_id", day("ts").alias("day"))


@query("merge_late", f"""WITH {D.INTER}, t AS (SELECT user_id, item_id, rating FROM inter WHERE ts < TIMESTAMP '1997-01-01'), s AS (SELECT user_id, item_id, CAST(5 AS BIGINT) AS rating FROM inter WHERE ts >= TIMESTAMP '1996-10-01' AND ts < TIMESTAMP '1997-02-01')
 SELECT user_id, item_id, coalesce(s.rating, t.rating) AS rating FROM t FULL JOIN s USING (user_id, item_id)""")
def merge_late(spark, sf):
    from sievework.operators.maintenance import merge

    inter = D.interactions(spark, sf)
    target = inter.where(F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz")).select("user_id", "item_id", "rating")
    source = inter.where(half_open(F.col("ts"), "1996-10-01", "1997-02-01")).select("user_id", "item_id", F.lit(5).cast("long").alias("rating"))
    return merge(target, source, D.KEYS)


@query("hash_sample")
def hash_sample(spark, sf):
    from sievework.sources.files import hash_sample as take

    return take(D.interactions(spark, sf).select("user_id", "item_id"), D.KEYS, 8, 500)


@query("last_per_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_per_key(spark, sf):
    from sievework.sources.files import last_per_key as last

    return last(D.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("build_measures", "SELECT count(*) AS items, count(*) FILTER (NOT regexp_matches(trim(p_type), '^\\$?\\d+(\\.\\d+)?$')) AS unparsed, count(*) FILTER (trim(p_brand) = '') AS no_brand, round(avg(CASE WHEN trim(p_name) = '' THEN 1.0 ELSE 0 END), 6) AS empty_title FROM part")
def build_measures(spark, sf):
    p = D.table(spark, sf, "part")
    return p.agg(F.count(F.lit(1)).alias("items"), F.count_if(X.parse_price(F.col("p_type")).isNull()).alias("unparsed"), F.count_if(F.trim("p_brand") == "").alias("no_brand"), F.round(F.avg((F.trim("p_name") == "").cast("double")), 6).alias("empty_title"))


@query("gate_ledger", f"SELECT 'r2' AS run_id, b AS batch, check_id, \"rows\" + b AS \"rows\" FROM ({SQL['gate_counts']}) CROSS JOIN (VALUES (0), (1)) t(b)")
def gate_ledger(spark, sf):
    """Gate counts of two runs as ledger rows, one batch of them appended twice, and the latest run read back."""
    path = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    counts = written(K.gate_counts(D.table(spark, sf, "lineitem"), LINES), "gate_counts")
    for run, batch in (("r1", 0), ("r2", 0), ("r2", 1), ("r2", 1)):
        ledger.append(counts.withColumn("rows", F.col("rows") + batch), path, run, batch)
    return ledger.latest_run(ledger.read(spark, path)).select("run_id", "batch", "check_id", "rows")
