"""Operator 3: quality rules with n-gram perplexity bands for each language.

The model is a modified Kneser-Ney model of order 5 over the code points of the texts as they are, one for each
language. Spark counts the n-grams of all documents, derives the lower orders, discounts and back-off weights by
grouping and joins, and gives each distinct n-gram its cost. So that a text isn't judged by what it alone taught, equal
texts of a language are counted once, and a count is that of all occurrences less the mean number in `FAMILY` documents
that have the n-gram: n-grams of so few documents (near copies, shared passages) count nothing and are scored by backing
off. A larger family of near copies that aren't equal still teaches itself.

Scoring looks n-grams up by binary search in a sorted array of hashes. That array is broadcast with at most `TURN`
entries, the most frequent ones; n-grams beyond it, all of them rarer, are joined with the cost table by shuffle, so
the model has no bound and memory has one.

A document is rejected if a base rule fails, or if its mean negative log probability lies outside its language's
band: median -/+ (WIDTH * MAD + SHORT / sqrt(characters)), over the language's documents that pass the base rules.
Nulls: a null text has no words (base rule fails), null languages are one language with the empty name. A text of
under five code points has no n-gram and no perplexity. Ties and repeated rows are each judged alone. An empty table
gives an empty result. Columns of the input that are named as the measures are carried as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.bloom import bloom, known
from sievework.llm.common import dropped, table, texts_of, trimmed_worker, utf8_batches, written
from sievework.llm.super_kmers import Words

ORDER = 5
#: Documents whose share is taken off an n-gram's count.
FAMILY = 4
WIDTH, SHORT, FLOOR = 4.0, 1.25, 0.01
#: Entries of the model that are broadcast (12 bytes each).
TURN = 4_000_000
#: So many languages' bands and discounts are broadcast.
FEW = 10_000
BATCH = 400_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Bytes that begin a code point of a word, and the symbols.
_IN_WORDS = np.array([b & 0xC0 != 0x80 and chr(b) not in SPACES for b in range(256)])
_SYMBOL = np.array([chr(b) in SYMBOLS for b in range(256)])
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _grams(texts: list[str], langs: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts; hash, start in them and text number of each n-gram inside a text."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < ORDER:
        return whole, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.flatnonzero(doc[: len(doc) - ORDER + 1] == doc[ORDER - 1 :])
    key = np.zeros(len(points) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        key = key * np.uint64(0x9E3779B97F4A7C15) + points[j : len(key) + j]
    doc = doc[starts]
    seeds = {x: _seed(x) for x in set(langs)}
    key = key[starts] ^ np.array([seeds[x] for x in langs], np.uint64)[doc]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return whole, key ^ (key >> np.uint64(29)), starts, doc


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[str]]]:
    """Rows with their texts and languages, about BATCH bytes at a time: no batch is held as strings whole."""
    for part, _, _ in utf8_batches(batches, "text", BATCH):
        yield part, texts_of(part), texts_of(part, "lang")


_COUNTS = "lang string, gram string, n long, docs long"
#: Counts of n-grams that a task adds up before it hands them on.
HELD = 500_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trimmed_worker()
    held, rows = [], 0

    def total() -> list[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(["lang", "gram"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select(["lang", "gram", "n_sum", "docs_sum"]).rename_columns(["lang", "gram", "n", "docs"]).combine_chunks().to_batches(100_000)

    for batch in _counts_of_parts(batches):
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield from total()
            held, rows = [], 0
    if held:
        yield from total()


def _counts_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts, langs in _parts(batches):
        whole, key, starts, doc = _grams(texts, langs)
        if not len(key):
            continue
        order = _order(key)  # texts stay in order for each n-gram
        k, d = key[order], doc[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        held = np.add.reduceat(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])].astype(np.int64), first)
        n = np.diff(np.r_[first, len(k)])
        for s in range(0, len(first), 100_000):
            at = order[first[s : s + 100_000]]
            names = pa.array([langs[i] for i in doc[at].tolist()], pa.string())
            grams = pa.array([whole[i : i + ORDER] for i in starts[at].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, grams, pa.array(n[s : s + 100_000]), pa.array(held[s : s + 100_000])], ["lang", "gram", "n", "docs"])


def _chosen(bits: Broadcast, copies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose hash the filter knows, or doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known(bits.value, batch.column(0).to_numpy()) == copies))

    return run


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n (occurrences), docs (documents that have it) over all different texts of a language.

    Only texts whose hash stands twice, or seems to in a filter, are shuffled, and compared whole.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "text")])
    hashed = plain.select(F.xxhash64("lang", "text").alias("h"), "lang", "text")
    twice = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(twice))
    single = hashed.mapInArrow(lambda batches: _count(_chosen(bits, False)(batches)), _COUNTS)
    copied = hashed.mapInArrow(_chosen(bits, True), hashed.schema).dropDuplicates(["lang", "text"]).mapInArrow(_count, _COUNTS)
    found = single.unionByName(copied)
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _left(order: int) -> Column:
    return F.substring("gram", 1, order - 1)


def _right(order: int) -> Column:
    return F.substring("gram", 2, order - 1)


def _discounts(counts: DataFrame, few: bool) -> DataFrame:
    """lang and the modified Kneser-Ney discounts d1, d2, d3 for counts of 1, 2 and 3 or more."""
    some = counts.groupBy("lang").agg(*[F.greatest(F.lit(1), F.count(F.when(F.col("c") == i, 1))).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.expr("n1 / (n1 + 2 * n2)")
    raw = {"d1": 1 - 2 * y * F.expr("n2 / n1"), "d2": 2 - 3 * y * F.expr("n3 / n2"), "d3": 3 - 4 * y * F.expr("n4 / n3")}
    found = some.select("lang", *[F.least(F.greatest(v, F.lit(0.0)), F.lit(float(i))).alias(k) for i, (k, v) in enumerate(raw.items(), 1)])
    return F.broadcast(found.sparkSession.createDataFrame(found.collect(), found.schema)) if few else written(found, "discounts")


def costs(counted: DataFrame, few: bool = True) -> DataFrame:
    """lang, gram, n, cost (negative log probability of the last code point after the others) of counted n-grams.

    Each order is written once, on the way down (shares and back-off weights) and on the way up (probabilities).
    """
    counts = written(counted.select("lang", "gram", F.floor(F.col("n") * (F.col("docs") - FAMILY) / F.col("docs")).alias("c")).where("c > 0"), "counts")
    asked, levels = counted.select("lang", "gram"), []
    for order in range(ORDER, 0, -1):
        d = counts.join(_discounts(counts, few), "lang").withColumn("off", F.expr("CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        siblings = Window.partitionBy("lang", "context")  # no more than there are code points
        level = d.withColumn("context", _left(order)).select(
            "lang", "gram", "context", ((F.col("c") - F.col("off")) / F.sum("c").over(siblings)).alias("share"), (F.sum("off").over(siblings) / F.sum("c").over(siblings)).alias("weight")
        )
        levels.append((order, asked, written(level, "level")))
        dropped(counts)
        if order > 1:
            # below the highest order an n-gram counts by how many code points stand before it
            counts = written(levels[-1][2].groupBy("lang", _right(order).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "counts")
            asked = written(asked.select("lang", _right(order).alias("gram")).distinct(), "asked")
    p = None
    for order, asked, level in reversed(levels):
        if p is None:  # one share for each known code point and one for all others
            known = level.groupBy("lang").agg(F.count(F.lit(1)).alias("known"))
            q = asked.join(F.broadcast(known) if few else known, "lang", "left").withColumn("lower", 1 / (1 + F.coalesce("known", F.lit(0)))).drop("known")
        else:
            q = asked.withColumn("low", _right(order)).join(p.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower")), ["lang", "low"]).drop("low")
        weights = level.groupBy("lang", "context").agg(F.max("weight").alias("weight"))
        q = (
            q.withColumn("context", _left(order)).join(weights, ["lang", "context"], "left").join(level.select("lang", "gram", "share"), ["lang", "gram"], "left")
            .select("lang", "gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p"))
        )
        below, p = p, written(q, "probabilities")
        dropped(level, asked, *([below] if below is not None else []))
    # equal probabilities whose sums were taken in another order stay equal
    return counted.join(p, ["lang", "gram"]).select("lang", "gram", "n", F.round(-F.log(F.greatest("p", F.lit(1e-12))), 6).alias("cost"))


class Model(NamedTuple):
    keys: np.ndarray  # sorted hashes of the most frequent n-grams
    costs: np.ndarray
    rare: DataFrame | None  # lang, gram, cost of all others
    languages: int


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, langs = texts_of(batch, "gram"), texts_of(batch, "lang")
        yield pa.RecordBatch.from_arrays([pa.array(_grams(grams, langs)[1].view(np.int64)), batch.column(batch.schema.get_field_index("cost"))], ["key", "cost"])


def model(docs: DataFrame) -> Model:
    counted = written(count_grams(docs), "grams")
    languages = counted.select("lang").distinct().count()
    table_ = written(costs(counted, languages <= FEW), "costs")
    dropped(counted)
    # the least count whose n-grams and all more frequent ones fit; counts are told apart by their leading bits
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    least, held, total = None, 0, 0
    for r in table_.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total <= TURN:
            least, held = r["level"], total
    often = table_.where(level >= (least if least is not None else 2**30)).select("lang", "gram", "cost")
    got = often.mapInArrow(_keyed, "key long, cost double").toArrow() if held else None
    keys = got["key"].to_numpy().view(np.uint64) if held else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    values = (got["cost"].to_numpy()[order] if held else np.zeros(0)).astype(np.float32)
    rare = table_.where(level < least if least is not None else F.lit(True)).select("lang", "gram", "cost") if held < total else None
    return Model(keys[order], values, rare, languages)


def _index(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Where each prefix of the sorted hashes begins, and the bits below a prefix; about as many prefixes as hashes."""
    bits = max(1, int(len(keys)).bit_length())
    ends = np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, ends), [len(keys)]]).astype(np.int32), 64 - bits


def _find(keys: np.ndarray, index: tuple[np.ndarray, int], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in the sorted ones, and which of them are there.

    The prefix gives the first and last place that a hash may have; what is left, about one place, is gone through.
    """
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    start, below = index
    prefix = (asked >> np.uint64(below)).astype(np.int64)
    at = start[prefix].astype(np.int64)
    there = np.zeros(len(asked), bool)
    left = np.flatnonzero(at < start[prefix + 1])
    while len(left):
        value, want = keys[at[left]], asked[left]
        there[left[value == want]] = True
        left = left[value < want]
        at[left] += 1
        left = left[at[left] < start[prefix[left] + 1]]
    return np.minimum(at, len(keys) - 1), there


def _order(key: np.ndarray) -> np.ndarray:
    """Their stable order. Hashes are sorted together with their places, unless two agree in all bits that this leaves."""
    low = np.uint64(2 ** max(1, len(key).bit_length()) - 1)
    packed = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    k = key[order]
    if np.any((k[1:] != k[:-1]) & ((k[1:] ^ k[:-1]) <= low)):
        return np.argsort(key, kind="stable")
    return order


def features(texts: list[str]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data], dtype=np.int64)
    offsets = np.concatenate([[0], ends])
    words = Words(raw, offsets)
    n = words.count.astype(np.int64)
    chars, symbols = (np.diff(np.concatenate([[0], np.cumsum(flags[raw], dtype=np.int64)])[offsets]) for flags in (_IN_WORDS, _SYMBOL))
    dups = np.array([_dup_lines(t) for t in texts], np.int64)
    h = words.hashes()
    repeats = np.zeros(len(texts), np.int64)
    if len(h) >= WINDOW:
        doc = np.repeat(np.arange(len(texts)), n)
        key = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            x = h[j : len(key) + j]
            key = key * np.uint64(0x9E3779B97F4A7C15) + (x ^ (x >> np.uint64(29)))
        inside = np.flatnonzero(doc[: len(key)] == doc[WINDOW - 1 :])
        key = (key[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = _order(key)
        k = key[order]
        same = k[1:] == k[:-1]
        twice = inside[order[np.r_[same, False] | np.r_[False, same]]]
        cover = np.zeros(len(h) + 1, np.int64)
        cover += np.bincount(twice, minlength=len(h) + 1)
        cover -= np.bincount(twice + WINDOW, minlength=len(h) + 1)
        repeats = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=len(texts))
    return [n, chars, symbols, dups, repeats]


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


def sent(spark: SparkSession, model: Model) -> Broadcast:
    """The frequent n-grams at the executors: one copy, however often documents are measured."""
    return spark.sparkContext.broadcast((model.keys, model.costs, _index(model.keys)))


def measured(docs: DataFrame, model: Model, shared: Broadcast | None = None) -> DataFrame:
    """The rows of `docs`, whole, with the features, base_failed and `cost`. shared: the model as it was `sent`."""
    shared = shared or sent(docs.sparkSession, model)
    own = [T.StructField(x, T.LongType()) for x in _FEATURES] + [T.StructField("base_failed", T.BooleanType()), T.StructField("__often", T.DoubleType()), T.StructField("__grams", T.LongType())]
    if model.rare is not None:
        docs = docs.withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(7), "text", F.coalesce("lang", F.lit("")))})
    schema = T.StructType([*docs.schema, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed_worker()
        keys, values, index = shared.value
        for part, texts, langs in _parts(batches):
            _, key, _, doc = _grams(texts, langs)
            at, there = _find(keys, index, key)
            often = np.bincount(doc[there], values[at[there]], len(texts)).astype(float)  # whole numbers if empty
            found = features(texts)
            arrays = [*part.columns, *map(pa.array, found), pa.array(base_failed(found[0], found[4])), pa.array(often), pa.array(np.bincount(doc, minlength=len(texts)))]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, index = shared.value
        for part, texts, langs in _parts(batches):
            whole, key, starts, doc = _grams(texts, langs)
            out = np.flatnonzero(~_find(keys, index, key)[1])
            order = out[np.lexsort((key[out], doc[out]))]
            first = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else np.zeros(0, np.int64)
            n, at = np.diff(np.r_[first, len(order)]), order[first]
            distinct = np.bincount(doc[at], minlength=len(texts))
            h1, h2 = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("__h1", "__h2"))
            for s in range(0, len(at), 100_000):
                some = at[s : s + 100_000]
                d = doc[some]
                arrays = [pa.array(h1[d]), pa.array(h2[d]), pa.array([langs[i] for i in d.tolist()], pa.string()), pa.array([whole[i : i + ORDER] for i in starts[some].tolist()], pa.string()), pa.array(n[s : s + 100_000]), pa.array(distinct[d])]
                yield pa.RecordBatch.from_arrays(arrays, ["__h1", "__h2", "lang", "gram", "n", "distinct"])

    rows, rare = docs.mapInArrow(run, schema), F.lit(0.0)
    if model.rare is not None:
        asked = docs.select("__h1", "__h2", "lang", "text").mapInArrow(missing, "__h1 long, __h2 long, lang string, gram string, n long, distinct long")
        # each copy of a text asks for the same `distinct` n-grams: their rows tell how many copies there are
        sums = asked.join(model.rare, ["lang", "gram"]).groupBy("__h1", "__h2").agg((F.sum(F.col("n") * F.col("cost")) * F.max("distinct") / F.count(F.lit(1))).alias("__rare"))
        rows, rare = rows.join(sums, ["__h1", "__h2"], "left").drop("__h1", "__h2"), F.coalesce("__rare", F.lit(0.0))
    cost = F.when(F.col("__grams") > 0, F.round((F.col("__often") + rare) / F.col("__grams"), 6))
    return rows.withColumn("cost", cost).drop("__often", "__grams", "__rare")


def bands(slim: DataFrame, languages: int) -> DataFrame:
    """(lang, mid, spread) from lang, cost and base_failed of all documents; to broadcast if there are few."""
    small = F.broadcast if languages <= FEW else lambda df: df
    clean = slim.where(~F.col("base_failed") & F.col("cost").isNotNull()).select(F.coalesce("lang", F.lit("")).alias("__lang"), "cost")
    mids = clean.groupBy("__lang").agg(F.percentile_approx("cost", 0.5, 10_000).alias("__mid"))
    off = clean.join(small(mids), "__lang").groupBy("__lang", "__mid").agg(F.percentile_approx(F.abs(F.col("cost") - F.col("__mid")), 0.5, 10_000).alias("__mad"))
    return small(off.withColumn("__mad", F.greatest("__mad", F.lit(FLOOR))))


def _kept(chars: Column) -> Column:
    wide = WIDTH * F.col("__mad") + SHORT / F.sqrt(F.greatest(chars, F.lit(1)).cast("double"))
    return ~F.col("base_failed") & F.coalesce(F.abs(F.col("cost") - F.col("__mid")) <= wide, F.lit(True))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the features, base_failed, kept and perplexity of each document."""
    found = model(docs)
    slim = written(measured(docs.select("doc_id", "text", "lang"), found).drop("text"), "quality")
    return (
        slim.withColumn("__lang", F.coalesce("lang", F.lit(""))).join(bands(slim, found.languages), "__lang", "left")
        .select("doc_id", *_FEATURES, "base_failed", _kept(F.col("word_chars")).alias("kept"), F.exp("cost").alias("perplexity"))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, as they are. Each is measured twice rather than shuffled with its text."""
    found = model(docs)
    shared = sent(docs.sparkSession, found)
    slim = written(measured(docs.select("text", "lang"), found, shared).select("lang", "cost", "base_failed"), "quality")
    # columns of the input that are named as the measures are set aside and carried
    clash = {c: f"__own_{c}" for c in docs.columns if c in {*_FEATURES, "base_failed", "cost"}}
    rows = measured(docs.withColumnsRenamed(clash), found, shared).withColumn("__lang", F.coalesce("lang", F.lit("")))
    kept = rows.join(bands(slim, found.languages), "__lang", "left").where(_kept(F.col("word_chars")))
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality_rules": op3}
