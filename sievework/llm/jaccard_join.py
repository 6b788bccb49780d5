"""Operator 8: exact Jaccard join of shingle sets in metric-space regions.

Distance is 1 - Jaccard, a metric; documents link within the radius r = 1 - percent / 100. `join` and `keep_one` take
the words of a shingle and the percent; the query's are `K` and `PERCENT`.

1. Equal sets are one class, represented by its least doc_id.
2. The first pivots are single shingles, in one order for all documents: hot shingles last, then by hash. The
   region of a pivot holds the sets that contain it among their first n - ceil(percent n / 100) + 1 shingles; the sets
   within r of one another share such a shingle, so a set is replicated to the regions of its prefix (its
   boundary) and no link is lost. Random sets are at distance 1 of each other, which is why pivots that are
   documents can only part sets inside such a region: on the whole corpus they part nothing.
3. Inside a region pivot documents take the members near them as their Voronoi cells and are verified with them; the
   pivots of large regions meet in regions of their own (module `regions`).
4. Regions with the same members are taken once, and those whose members are in one component are done. Of the
   others, pairs between components that sizes and counts of shingles by hash cell leave possible are verified.

Links are verified on whole sets; components are those of the links. Nulls and texts without words have the empty
set and link with nothing; a text of fewer than `k` words is one shingle. A row without doc_id stands alone. Rows
that share a doc_id are compared by their own texts; the component of each is that of its text. An empty table gives
an empty result. Only doc_id and text are read, so other columns of any name can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bloom import bloom, known, mix
from sievework.llm.common import dropped, table, utf8_batches, written
from sievework.llm.graph import components
from sievework.llm.regions import CELLS, ROWS, connect, groups, once, shared_counts

K, PERCENT = 4, 85
BATCH = 1_000_000
TOGETHER = 1_000_000
#: A cell counts so far; a set with a full cell has no bound.
MOST_CELL = 255
#: Sets of more shingles are compared by so many cells before they travel whole.
LARGE, WIDE = 800, 4096
#: The order of shingles puts these last: seen in a batch by so many texts, so often in all, at most so many.
HOT_IN_BATCH, HOT_IN_ALL, HOT_MOST = 3, 60, 200_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(54321).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    full = np.flatnonzero(np.diff(offsets) > 0)
    begins, ends = np.r_[True, space[:-1]], np.r_[space[1:], True]
    begins[offsets[full]] = True
    ends[offsets[full + 1] - 1] = True
    first, last = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1
    folded = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    power = np.multiply.accumulate(np.full(n + 1, _MULT, np.uint64))
    back = np.multiply.accumulate(np.full(n + 1, pow(int(_MULT), -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[folded] * power[:n], dtype=np.uint64)])
    h = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return np.searchsorted(offsets, first, side="right") - 1, h


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle), sorted; the shingles as signed 64-bit hashes."""
    text, h = words(data, offsets)
    count = np.bincount(text, minlength=len(offsets) - 1)
    keys, owners = [], []
    m = max(0, len(h) - k + 1)
    if m:
        key = np.zeros(m, np.uint64)
        for j in range(k):
            key = key * _MULT + h[j : m + j]
        inside = text[:m] == text[k - 1 :]
        keys.append(key[inside])
        owners.append(text[:m][inside])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        start = np.cumsum(count) - count
        key = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            more = j < count[few]
            key[more] = key[more] * _MULT + h[start[few][more] + j]
        keys.append(key + count[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        owners.append(few)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, owner = mix(np.concatenate(keys)).view(np.int64), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    return owner[new], key[new]


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any set it links with."""
    return (percent * n + 99) // 100


def _hot(docs: DataFrame, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in utf8_batches(batches, "text", BATCH):
            _, key = shingles(data, offsets, k)
            found, n = np.unique(key, return_counts=True)
            often = n >= HOT_IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(found[often]), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= HOT_IN_ALL).orderBy(F.col("n").desc(), "shingle").limit(HOT_MOST).select("shingle").toPandas()
    return np.sort(best["shingle"].to_numpy(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _set_hash(owner: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    sums = np.zeros(texts, np.uint64)
    np.add.at(sums, owner, mix(key.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
    return sums.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long, a hash that parts the texts of one doc_id, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")


def _sets(docs: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, set_hash, the prefix and cells of each text.

    Cells count the shingles by the first bits of their hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for part, data, offsets in utf8_batches(batches, "text", BATCH):
            owner, key = shingles(data, offsets, k)
            n = np.bincount(owner, minlength=part.num_rows)
            sums = _set_hash(owner, key, part.num_rows)
            if len(last):
                at = np.minimum(np.searchsorted(last, key), len(last) - 1)
                order = np.lexsort((key, last[at] == key, owner))
                key = key[order]
            length = np.minimum(n, n - _need(n, percent) + 1)
            rank = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            prefix = key[rank < np.repeat(length, n)]
            cells = np.bincount(owner * CELLS + (key.view(np.uint64) >> np.uint64(57)).astype(np.int64), minlength=part.num_rows * CELLS)
            counts = np.minimum(cells, MOST_CELL).astype(np.uint8).reshape(-1, CELLS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(sums), _lists(prefix, length), pa.array([c.tobytes() for c in counts], pa.binary())], ["doc_id", "tie", "n", "set_hash", "prefix", "cells"])

    found = _keyed(docs).mapInArrow(run, "doc_id long, tie long, n long, set_hash long, prefix array<long>, cells binary")
    return found.withColumn("node", F.xxhash64("set_hash", "n"))


def near(percent: int):
    """Two sets share no more than the lesser count of each cell, summed."""

    def of(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        shared = shared_counts(x, y, np.minimum)
        lesser, greater = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
        full = (x >= MOST_CELL).any(1)[:, None] | (y >= MOST_CELL).any(1)[None, :]
        shared = np.where(full, lesser, np.minimum(shared, lesser))
        return (100 * shared >= percent * (n[:, None] + m[None, :] - shared)) & (100 * lesser >= percent * greater)

    return of


def _of_nodes(docs: DataFrame, nodes: DataFrame, k: int, kind: str, make) -> DataFrame:
    """(node, value) of nodes (node, rep): `make` of the shingles of one document of each."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(nodes.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            asked = batch.filter(pa.array(known(bits, batch.column(0).to_numpy())))
            for part, data, offsets in utf8_batches(iter([asked]), "text", BATCH):
                owner, key = shingles(data, offsets, k)
                n = np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(owner, key, part.num_rows)), pa.array(n), make(owner, key, n)], ["set_hash", "n", "value"])

    read = _keyed(docs).where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"set_hash long, n long, value {kind}")
    # rows that share a doc_id with the one asked for go here
    return read.select(F.xxhash64("set_hash", "n").alias("node"), "value").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _wide(owner: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.Array:
    cells = np.bincount(owner * WIDE + (key.view(np.uint64) >> np.uint64(52)).astype(np.int64), minlength=len(n) * WIDE)
    return pa.array([c.tobytes() for c in np.minimum(cells, MOST_CELL).astype(np.uint8).reshape(-1, WIDE)], pa.binary())


def _perhaps(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with sizes n and m that counts in `WIDE` cells leave possible, for sets that are large for fewer."""
    nodes = written(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("rep")), F.struct(F.col("b").alias("node"), F.col("rb").alias("rep")))).alias("x")).select("x.*").distinct(), "long_nodes")
    wide = written(_of_nodes(docs, nodes, k, "binary", _wide), "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                n, m = part.column(2).to_numpy(), part.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, WIDE) for i in (4, 5))
                full = (x == MOST_CELL).any(1) | (y == MOST_CELL).any(1)
                same = np.where(full, np.minimum(n, m), np.minimum(x, y).sum(1, dtype=np.int64))
                left = pa.array(100 * same >= percent * (n + m - same))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(left), part.column(1).filter(left)], ["a", "b"])

    both = pairs.select("a", "b", "n", "m").join(wide.toDF("a", "x"), "a").join(wide.toDF("b", "y"), "b")
    found = written(both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "possible")
    dropped(nodes, wide)
    return found


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by whole sets of one document of each."""
    of = classes.select("node", "rep", "n")
    sized = written(pairs.select("a", "b").join(of.toDF("a", "ra", "n"), "a").join(of.toDF("b", "rb", "m"), "b"), "sized")
    large = F.greatest("n", "m") > LARGE
    pairs = written(sized.where(~large).select("a", "b").unionByName(_perhaps(docs, sized.where(large), k, percent)), "left")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(of, "node"), "asked")
    sets = written(_of_nodes(docs, ids, k, "array<long>", lambda owner, key, n: _lists(key, n)), "sets")
    found = written(_compared(pairs, ids.select("node", "n"), sets.toDF("node", "set"), percent), "linked")
    dropped(sized, ids, sets)
    return found


def _compared(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. Sets that pairs connect meet in blocks of about `TOGETHER` shingles, once in a pair of blocks."""
    root = components(pairs)
    of = written(sizes.join(root, "node", "left").select("node", "n", F.coalesce("root", "node").alias("group")), "groups")
    blocks = of.groupBy("group").agg(F.ceil(F.sum("n") / TOGETHER).cast("long").alias("blocks"))
    of = of.join(blocks, "group").select("node", "group", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    both = pairs.join(of.toDF("a", "group", "i"), "a").join(of.toDF("b", "same", "j"), "b")
    dealt = written(both.select("group", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a", "b"), "dealt")
    wanted = dealt.select("group", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    rows = wanted.select("group", "i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = rows.unionByName(dealt.withColumn("set", F.lit(None).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups(batches, 3):
            has = part.column(4).is_null().to_numpy(zero_copy_only=False)
            held, asked = part.filter(pa.array(has)), part.filter(pa.array(~has))
            nodes = held.column(3).to_numpy()
            order = np.argsort(nodes)
            size = np.asarray(held.column(5).value_lengths()).astype(np.int64)
            begin = np.cumsum(size) - size
            kinds, local = np.unique(held.column(5).flatten().to_numpy(), return_inverse=True)
            a, b = (order[np.searchsorted(nodes[order], asked.column(c).to_numpy())] for c in (3, 4))
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            mark = np.zeros(len(kinds), bool)
            same = np.zeros(len(a), np.int64)
            for x in np.unique(a):
                own = local[begin[x] : begin[x] + size[x]]
                mark[own] = True
                low, high = np.searchsorted(a, x), np.searchsorted(a, x, side="right")
                same[low:high] = [np.count_nonzero(mark[local[begin[y] : begin[y] + size[y]]]) for y in b[low:high]]
                mark[own] = False
            linked = 100 * same >= percent * (size[a] + size[b] - same)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a[linked]]), pa.array(nodes[b[linked]])], ["a", "b"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("group", "i", "j", "a", "b", "set").repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return rows.mapInArrow(run, "a long, b long")


def roots(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes that links connect."""
    region = classes.where("n > 1").select("node", "n", "prefix", "cells")
    several = written(once(region.select(F.explode("prefix").alias("region"), F.col("node").alias("rep"))), "regions")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(several.select("region")))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                lists = part.column(2)
                key = lists.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                hit = known(bits, key)
                rows = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), *[part.column(i).take(rows) for i in (0, 1, 3)]], ["region", "rep", "size", "cells"])

    rows = region.mapInArrow(explode, ROWS).join(several.select("region", "members"), "region")
    return connect(rows, near(percent), lambda pairs: _linked(docs, classes, pairs, k, percent))


def components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, tie, n, component, first) of each row; component and first are null for those linked with nothing.

    first: the least (doc_id, tie) of the component.
    """
    docs = docs.select("doc_id", "text")
    sets = written(_sets(docs, _hot(docs, k), k, percent), "shingles")
    least = F.min(F.struct("doc_id", "tie")).alias("first")
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.any_value("n").alias("n"), least, F.any_value("prefix").alias("prefix"), F.any_value("cells").alias("cells")).withColumn("rep", F.col("first.doc_id")), "classes")
    rows = written(sets.select("doc_id", "tie", "n", "node"), "rows")
    dropped(sets)
    found = roots(docs, classes, k, percent)
    named = classes.select("node", "first").join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    named = written(named.select("node", "component").join(firsts, "component"), "named")
    dropped(classes)
    return rows.join(named, "node", "left").select("doc_id", "tie", "n", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    return components_of(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each component the row with the least doc_id (of equal ones: the least hash of the text), once.

    Rows without doc_id or without words are linked with nothing and stay. Columns of any name are carried through.
    """
    found = components_of(docs, k, percent).where("first is not null").select(F.col("first.doc_id").alias("__kept_doc"), F.col("first.tie").alias("__kept_tie")).distinct()
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    linked = F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(linked).withColumn("__tie", tie).join(found, (F.col("doc_id").cast("long") == F.col("__kept_doc")) & (F.col("__tie") == F.col("__kept_tie")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__tie"]).drop("__tie").unionByName(docs.where(~linked)).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_jaccard_join": op8}
