"""Operator 11: audit of how the sources of a language diverge, by exact smoothed term probabilities.

Every (lang, source) group and every language give each kept term (one in at least `LEAST_DOCS` documents of the
language) p = 1 + floor(SCALE * (count + 2) / (N + 2 V)). Two such distributions differ in a term by
f = floor((p - q)^2 / (p + q)).

1. Tasks count terms of their own documents before Spark adds the counts up by (lang, source, term).
2. Terms in which a group exceeds its language most are searched by upper bounds. A group's terms lie in buckets of
   like counts; as f grows with p and falls with q while p > q, a bucket's greatest p and least q bound it. Rounds
   evaluate each group's buckets best first, four times as many in each, and a group ends once the bounds of all its
   unseen buckets lie strictly below its kth value (equal ones may still win by name).
3. Pairs of sources are summed from postings: blocks of sources meet by chunks of terms in which absent counts are
   filled in, so a task returns one sum for each pair and chunk, never a row for each pair and term. Terms that neither
   block has add a constant that is multiplied out.

No list of terms, groups or pairs is held whole by one task or the driver. All arithmetic is of whole numbers, the
product SCALE * count of decimals.

Null texts, langs and sources are ''. Empty texts and texts without terms make groups without counts. Ties are ranked by
the UTF-8 bytes of the item. Repeated rows, whatever their doc_id, count as documents each. Texts of any length are
counted whole, a few megabytes at a time. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import table, written

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Distinct terms that a task counts before it hands them on, bytes of a text that are split at once.
HELD, PIECE = 300_000, 4_000_000
#: Sources in a block, rows in a chunk of terms, terms of a chunk that are compared at once.
BLOCK, CHUNK, TILE = 48, 50_000, 4096

#: A-Z to a-z, all other ASCII but letters to a space; bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Counter:
    """How often each term, as UTF-8 bytes, stands in the text."""
    data = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    if len(data) <= PIECE:
        return Counter(data.split())
    out, start = Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[start:end].split())
        start = end
    return out


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some documents at a time."""
    one = 1 << 40  # documents are counted above the occurrences, which stay below 2^40 between two flushes
    held: dict[tuple[str, str], dict[bytes, int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*group, term, n) for group, counts in held.items() for term, n in counts.items()]
        n = np.array([r[3] for r in rows], np.int64)
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
        term = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
        held.clear()
        return pa.RecordBatch.from_arrays([*columns, term, pa.array(n & (one - 1)), pa.array(n >> 40)], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(i) for i in range(3)], strict=True):
            counts = held.setdefault((lang.as_py(), source.as_py()), {})
            size -= len(counts)
            for term, n in terms_of(text.as_py()).items():
                counts[term] = counts.get(term, 0) + n + one
            size += len(counts)
            if size > HELD:
                yield flush()
                size = 0
    if size:
        yield flush()


def _p(count: Column, mass: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / mass), of decimals as the product may pass 64 bits."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, mass.cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bucket(n: Column) -> Column:
    """Each count up to 16, above it eight buckets for each doubling."""
    return F.when(n <= 16, n).otherwise(16 + F.floor(F.log2(n / 16.0) * 8)).cast("int")


def measure(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings): (lang, source, v, n, mass) of every group; (lang, source, term, n, p, q, bucket)."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = plain.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    plainly = written(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept")
    langs = plainly.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_n"))
    of_group = plainly.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = plain.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = written(groups.select("lang", "source", "v", "n", (F.col("n") + 2 * F.col("v")).alias("mass"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_mass")), "groups")
    masses = groups.select("lang", "source", "mass", "lang_mass")
    scored = plainly.join(masses, ["lang", "source"]).select("lang", "source", "term", "n", _p(F.col("n"), F.col("mass")).alias("p"), _p(F.col("total"), F.col("lang_mass")).alias("q"), _bucket(F.col("n")).alias("bucket"))
    return groups, written(scored, "postings")


GROUP = ["lang", "source"]


def best_terms(postings: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank) of each group's k terms of greatest f among those with p > q."""
    above = postings.where("p > q")
    buckets = above.groupBy(*GROUP, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"))
    bounds = buckets.select(*GROUP, "bucket", _f(F.col("p"), F.col("q")).alias("bound"))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("bound").desc(), "bucket"))
    bounds = written(bounds.withColumn("place", place), "bounds")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "term"))
    top, seen, upto = None, 0, 4
    while True:
        chosen = bounds.where((F.col("place") > seen) & (F.col("place") <= upto))
        if top is not None:
            kth = top.where(F.col("rank") == k).select(*GROUP, F.col("value").alias("kth"))
            chosen = chosen.join(kth, GROUP, "left").where("kth is null or bound >= kth")
        chosen = written(chosen.select(*GROUP, "bucket"), "chosen")
        if top is not None and chosen.isEmpty():  # bounds fall with the place, so what follows is lower still
            return top
        found = above.join(chosen, [*GROUP, "bucket"]).select(*GROUP, "term", _f(F.col("p"), F.col("q")).alias("value"))
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = written(found.withColumn("rank", rank).where(F.col("rank") <= k), "top")
        seen, upto = upto, upto * 4


def _sums_of_pairs(rows: pa.Table) -> pa.Table:
    """Of one pair of blocks and one chunk of terms: for each pair of sources the sum of f over the chunk's terms."""
    marks = rows.filter(pc.is_null(rows["term"]))
    source, block, floor = marks["source"].to_pylist(), marks["block"].to_numpy(), marks["p"].to_numpy()
    at = {s: i for i, s in enumerate(source)}
    postings = rows.filter(pc.is_valid(rows["term"]))
    code = postings["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(postings) else np.zeros(0, np.int64)
    owner = np.array([at[s] for s in postings["source"].to_pylist()], np.int64)
    p, terms = postings["p"].to_numpy(), int(code.max()) + 1 if len(code) else 0
    left, right = rows["b1"][0].as_py(), rows["b2"][0].as_py()
    first, second = np.flatnonzero(block == left), np.flatnonzero(block == right)
    sums = np.zeros((len(first), len(second)), np.int64)
    order = np.argsort(code, kind="stable")
    code, owner, p = code[order], owner[order], p[order]
    for t in range(0, terms, TILE):
        low, high = np.searchsorted(code, [t, t + TILE])
        filled = np.repeat(floor[:, None], min(TILE, terms - t), 1)
        filled[owner[low:high], code[low:high] - t] = p[low:high]
        for i, s in enumerate(first):
            a, b = filled[s], filled[second]
            sums[i] += ((a - b) ** 2 // (a + b)).sum(1)
    out = [(source[s], source[t], int(sums[i, j]), int(floor[s]), int(floor[t])) for i, s in enumerate(first) for j, t in enumerate(second) if left != right or source[s] < source[t]]
    columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])]
    lang = pa.array([rows["lang"][0].as_py()] * len(out), pa.string())
    return pa.table([lang, *columns, pa.array([terms] * len(out), pa.int64())], names=["lang", "s", "t", "value", "s_floor", "t_floor", "terms"])


def pair_values(groups: DataFrame, postings: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, item, value): each two sources of a language, both ways."""
    rows = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    shape = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v")).join(rows, "lang", "left").fillna(0, ["rows"])
    blocks = F.ceil(F.col("sources") / block).cast("int")
    shape = written(shape.select("lang", "v", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / blocks / chunk)).cast("int").alias("chunks")), "shape")
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    floor = F.when(F.col("v") > 0, _p(F.lit(0), F.greatest(F.col("mass"), F.lit(1)))).otherwise(F.lit(1))
    # a row without a term tells each chunk of a source that may have no posting in it
    marks = groups.drop("v").join(shape, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), floor.alias("p"), own.alias("block"), "blocks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = postings.join(shape, "lang").select("lang", "source", "term", "p", own.alias("block"), "blocks", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    met = marks.unionByName(dealt).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", "source", "term", "p", "block", "chunk", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    sums = met.groupBy("lang", "b1", "b2", "chunk").applyInArrow(_sums_of_pairs, "lang string, s string, t string, value long, s_floor long, t_floor long, terms long")
    total = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("s_floor").alias("p"), F.max("t_floor").alias("q"))
    value = F.col("value") + (F.col("v") - F.col("terms")) * _f(F.col("p"), F.col("q"))
    total = total.join(shape.select("lang", "v"), "lang").select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("both"))
    return total.select("lang", "both.source", "both.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's other sources by divergence and its k most excessive terms."""
    groups, postings = measure(docs, least_docs)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")).cast("int")
    pairs = pair_values(groups, postings).select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = best_terms(postings, k).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
    return pairs.unionByName(terms)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11}

ORACLE_SQL = {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + (1000000000 * (kept.total + 2)) // (l.n + 2 * l.v) AS q
 FROM g JOIN l USING (lang) JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM full_ WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10"""
}
