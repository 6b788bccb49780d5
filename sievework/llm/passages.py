"""Operator 10: suffix-array dedup of byte passages of at least 200 bytes.

Every 200-byte window is represented by the smallest hashed 32-gram in it, its anchor; windows with equal bytes
have equal anchors at equal places, so only texts around equal anchors can repeat. Neighbouring windows with
one anchor form a run, whose bytes are its context.

1. Spark counts anchors, and contexts of each anchor. An anchor that occurs once repeats nothing; contexts that
   occur twice or more repeat whole. Contexts are compared as (anchor, context) classes, so a passage that
   stands in many documents is looked at once.
2. Of anchors with several distinct contexts, one context of each class is sent to the anchor's partition. There a
   suffix array of some megabytes of contexts gives their Burrows-Wheeler transform, on which intervals are
   extended backwards breadth first: level l settles the boundaries whose common prefix is l - 1, and the search
   stops at 200, when the boundaries not yet settled are those of windows that repeat (`repeated`).
3. Ranges of repeated windows go back to all runs of their class, one row for each class, and become spans of their
   documents.

An anchor with more than `HOT` distinct contexts is not held by one task: its contexts are split into pieces by a
second gram (`pieces`), equal pieces are counted, and each second gram has a transform of its own. Only where a pair
of grams has more than `HOT` distinct pieces, which no task could hold, windows are counted by their hash instead.

Nulls: a null text is empty. Texts of fewer than 200 bytes repeat nothing. Copies of a text repeat each other,
repeated rows too. An empty table gives an empty result. Other columns are never read by `digests`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from sievework.llm.bloom import bloom, known, mix
from sievework.llm.common import table, utf8_batches, written

LEAST, GRAM = 200, 32
SPAN = LEAST - GRAM + 1
HOT = 20_000
SEGMENT = 8_000_000
BATCH = 1_000_000
BWT_BYTES = 2_000_000

_MULT = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(12345).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sum_hash(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of t[start:end] for each pair, the same wherever the bytes stand."""
    n = len(t)
    power = np.multiply.accumulate(np.full(n + 1, _MULT, np.uint64))
    back = np.multiply.accumulate(np.full(n + 1, pow(_MULT, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * power[:n], dtype=np.uint64)])
    return (sums[end] - sums[start]) * back[start]


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows: text, first window (`start`, in bytes of the text), `windows`, `anchor` and `context`."""
    if len(data) > 2 * SEGMENT and len(offsets) == 2:
        parts = []
        for s in range(0, len(data) - LEAST + 1, SEGMENT):
            piece = data[s : s + SEGMENT + LEAST - 1]
            found = runs(piece, np.array([0, len(piece)]))
            found["start"] = found["start"] + s
            parts.append(found)
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = len(data)
    empty = {"text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "windows": np.zeros(0, np.int64), "anchor": np.zeros(0, np.int64), "context": np.zeros(0, np.int64)}
    if n < LEAST:
        return empty
    t = _BYTES[data]
    h = _grams(data)
    # the least gram of each window, the leftmost of equals
    key = _placed(h)
    k = np.concatenate([key, np.full(-len(key) % SPAN, 2**64 - 1, np.uint64)]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(k, 1).ravel()
    behind = np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    count = n - LEAST + 1
    at = (np.minimum(behind[:count], ahead[SPAN - 1 : SPAN - 1 + count]) & np.uint64(2**24 - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(text[:count] == text[LEAST - 1 :])
    if not len(window):
        return empty
    at, text = at[window], text[window]
    first = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1]
    last = np.r_[first[1:], len(window)] - 1
    low, high, at, text = window[first], window[last], at[first], text[first]
    context = mix(_sum_hash(t, low, high + LEAST) + mix((high - low).astype(np.uint64) * np.uint64(1000) + (at - low).astype(np.uint64)))
    return {"text": text, "start": low - offsets[text], "windows": high - low + 1, "anchor": h[at].view(np.int64), "context": context.view(np.int64)}


def _suffixes(x: np.ndarray) -> np.ndarray:
    """Rotations of x in the order of their first 224 symbols."""
    n = len(x)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | np.roll(x, -j)
    order, depth = np.argsort(key), 7
    while True:
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, (sorted_[1:] != sorted_[:-1]).astype(np.int64)])
        if depth >= LEAST:
            return order
        key = rank * n + np.roll(rank, -depth)
        order = np.argsort(key)
        depth *= 2


def repeated(contexts: list[bytes], least: int = LEAST) -> np.ndarray:
    """For each byte of the joined contexts, whether the `least` bytes from there lie in one context and recur.

    Breadth-first backward extension on the Burrows-Wheeler transform: the intervals that level l adds end at the
    boundaries where the common prefix is l - 1, and each boundary is added once; it stops at `least`.
    """
    x = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(c) + 1 for c in contexts]) - 1
    x[ends] = 0
    n = len(x)
    suffix = _suffixes(x)
    bwt = x[suffix - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)  # where the rotation that starts one symbol earlier stands
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, before = np.full(n, n), np.full(n, -1)  # the next and the last place with this symbol
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(1, least + 1):
        size = high - low
        place = np.arange(size.sum()) + np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size)
        firsts = np.sort(to[place[before[place] < np.repeat(low, size)]])
        lasts = np.sort(to[place[after[place] >= np.repeat(high, size)]]) + 1
        # intervals that end at a boundary settled before need no extension, those of the first level do
        new = ~settled[lasts] if level > 1 else np.ones(len(lasts), bool)
        low, high = firsts[new], lasts[new]
        settled[high] = True
        if not len(low):
            break
    out = np.zeros(n, bool)
    out[suffix] = ~settled[:-1] | ~settled[1:]
    start = np.repeat(np.r_[0, ends[:-1] + 1], np.diff(np.r_[-1, ends]))
    inside = np.arange(n) + least <= np.repeat(ends, np.diff(np.r_[-1, ends]))
    return np.delete(out & inside & (start >= 0), ends)


def _ranges(flags: np.ndarray) -> np.ndarray:
    """[first, last] of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return np.stack([edge[::2], edge[1::2] - 1], 1) if len(edge) else np.zeros((0, 2), np.int64)


_RUN = "doc_id long, tie long, start long, windows int, anchor long, context long"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long (null: the least one), a hash of the text that parts rows of one id, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in utf8_batches(batches, "text", BATCH):
        r = runs(data, offsets)
        rows = pa.array(r["text"])
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(r["start"]), pa.array(r["windows"], pa.int32()), pa.array(r["anchor"]), pa.array(r["context"])], ["doc_id", "tie", "start", "windows", "anchor", "context"])


def _place(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * np.uint64(_MULT) + mix(tie.view(np.uint64) + mix(start.astype(np.uint64)))).view(np.int64)


def _contexts(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """Runs that the filter knows, with their bytes."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part, data, offsets in utf8_batches(batches, "text", BATCH):
            r = runs(data, offsets)
            doc, tie = (part.column(i).to_numpy()[r["text"]] for i in (0, 1))
            at = np.flatnonzero(known(bits, _place(doc, tie, r["start"])))
            low = offsets[r["text"][at]] + r["start"][at]
            texts = [data[a : a + w + LEAST - 1].tobytes() for a, w in zip(low, r["windows"][at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["anchor"][at]), pa.array(r["context"][at]), pa.array(texts, pa.binary())], ["anchor", "context", "bytes"])

    return keyed.mapInArrow(run, "anchor long, context long, bytes binary")


_SPANS = "array<struct<first:int,last:int>>"
_RANGE = f"group long, member long, spans {_SPANS}"


def _range_batch(group: list, member: list, whole: list, contexts: list[bytes], flags: np.ndarray) -> pa.RecordBatch:
    """One row for each member that isn't whole and has a repeated window: the disjoint ranges of those windows."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    found = _ranges(flags)
    # a run of flags can't reach from one context into the next, as windows end 199 bytes before
    owner = np.searchsorted(ends, found[:, 0], side="right")
    asked = ~np.array(whole, bool)[owner]
    owner, found = owner[asked], found[asked] - (ends - sizes)[owner[asked]][:, None]
    has, count = np.unique(owner, return_counts=True)
    span = pa.StructArray.from_arrays([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1].astype(np.int32))], ["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), span)
    return pa.RecordBatch.from_arrays([pa.array(np.array(group, np.int64)[has]), pa.array(np.array(member, np.int64)[has]), lists], ["group", "member", "spans"])


def _expand_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups together, some megabytes at a time; rows come sorted by group."""
    held: list[list] = [[], [], [], []]
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if size > BWT_BYTES and row[0] != held[0][-1]:
                yield _range_batch(*held, repeated(held[3]))
                held, size = [[], [], [], []], 0
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[3])
    if size:
        yield _range_batch(*held, repeated(held[3]))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, member, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            first = np.arange(len(data) - LEAST + 1)
            h = mix(_sum_hash(_BYTES[np.frombuffer(data, np.uint8)], first, first + LEAST))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(first), pa.int64()), pa.array([member] * len(first), pa.int64()), pa.array(first.astype(np.int32)), pa.array(h.view(np.int64))], ["group", "member", "first", "hash"])


def _grams(data: np.ndarray) -> np.ndarray:
    h, s = _BYTES[data], 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(_MULT, s, 2**64)) + h[s:]
        s *= 2
    return mix(h)


def _placed(h: np.ndarray) -> np.ndarray:
    """40 bits of hashes with their places, so that minima are the leftmost of equals."""
    return (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype=np.uint64)


#: Grams of the 84 bytes at the end of a window that is further from its anchor.
FAR = LEAST - GRAM - (LEAST - GRAM) // 2 - GRAM + 1


def pieces(data: bytes) -> list[tuple[int, int, int, int]]:
    """Runs of a context's windows by a second gram: (first, last, key of the gram and its place, key of the bytes).

    The second gram is the least one, in another order, in the end of the window that is further from the anchor, so
    what is the same around the anchor in many texts doesn't keep their windows together.
    """
    x = np.frombuffer(data, np.uint8)
    h = _grams(x)
    anchor = int(np.argmin(_placed(h)[:SPAN]))
    count = len(x) - LEAST + 1
    least = np.lib.stride_tricks.sliding_window_view(_placed(mix(h ^ np.uint64(0x5851F42D4C957F2D))), FAR).min(1)
    place = np.arange(count)
    left = 2 * (anchor - place) >= LEAST - GRAM
    at = (np.where(left, least[:count], least[place + SPAN - FAR]) & np.uint64(2**24 - 1)).astype(np.int64)
    first = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (left[1:] != left[:-1])) + 1]
    last = np.r_[first[1:], count] - 1
    key = mix(h[at[first]] + (at[first] - anchor).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    same = mix(_sum_hash(_BYTES[x], first, last + LEAST) + mix((last - first).astype(np.uint64) * np.uint64(1000) + (at[first] - first).astype(np.uint64)))
    return list(zip(first.tolist(), last.tolist(), key.view(np.int64).tolist(), same.view(np.int64).tolist(), strict=True))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 500):
            part = batch.slice(s, 500)
            anchor, context, whole, texts = ([x for x in part.column(i).to_pylist()] for i in range(4))
            rows = [(a, c, w, at, k ^ a, m, t[at : last + LEAST]) for a, c, w, t in zip(anchor, context, whole, texts, strict=True) for at, last, k, m in pieces(t)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["anchor", "context", "whole", "at", "group", "member", "bytes"])


def _settled(members: DataFrame, hot: int) -> DataFrame:
    """(group, member, spans) of members (group, member, whole, bytes), each once, that aren't whole.

    A transform of each group; windows of groups with more than `hot` members are counted by their hash.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("group", F.lit(True).alias("hot"))
    more = None
    if not many.isEmpty():
        marked = written(members.join(many, "group", "left"), "marked")
        windows = written(marked.where("hot").select("group", "member", "bytes").mapInArrow(_window_hashes, "group long, member long, first int, hash long"), "windows")
        twice = windows.groupBy("group", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "hash")
        repeats = windows.join(twice, ["group", "hash"]).join(marked.where("hot and not whole").select("group", "member"), ["group", "member"], "left_semi")
        more = repeats.groupBy("group", "member").agg(F.collect_set("first").alias("first")).mapInArrow(_merge_places, _RANGE)
        members = marked.where("hot is null")
    few = members.select("group", "member", "whole", "bytes").repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_expand_intervals, _RANGE)
    return few if more is None else few.unionByName(more)


def _merge_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows, at most some hundreds for each member, to disjoint ranges."""
    for batch in batches:
        out = []
        for places in batch.column(2).to_pylist():
            p = np.sort(np.array(places, np.int64))
            cut = np.flatnonzero(np.diff(p) > 1)
            out.append([{"first": int(a), "last": int(b)} for a, b in zip(p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["group", "member", "spans"])


def _split(members: DataFrame, hot: int) -> DataFrame:
    """(group, member, spans) of the members of hot anchors, by pieces that have a second gram in common."""
    rows = written(members.mapInArrow(_pieces, "anchor long, context long, whole boolean, at int, group long, member long, bytes binary"), "pieces")
    kinds = written(rows.groupBy("group", "member").agg((F.count(F.lit(1)) > 1).alias("whole"), F.any_value("bytes").alias("bytes")), "piece_kinds")
    every = kinds.where("whole").select("group", "member", F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("bytes") - LEAST).cast("int").alias("last"))).alias("spans"))
    found = written(every.unionByName(_settled(kinds, hot)), "piece_spans")
    asked = rows.where("not whole").select("anchor", "context", "at", "group", "member").join(found, ["group", "member"])
    moved = F.transform("spans", lambda x: F.struct((x["first"] + F.col("at")).alias("first"), (x["last"] + F.col("at")).alias("last")))
    return asked.groupBy("anchor", "context").agg(F.flatten(F.collect_list(moved)).alias("spans")).toDF("group", "member", "spans")


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, tie, start, end): bytes of texts that a repeated window covers; spans may overlap."""
    keyed = _keyed(docs)
    long_ = keyed.where(F.octet_length("text") >= LEAST)
    found = written(long_.mapInArrow(_runs, _RUN), "runs")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    # written before they are joined, so that hot anchors are dealt over several tasks
    again = written(found.join(written(anchors.select("anchor", (F.col("low") == F.col("high")).alias("alike")), "anchors"), "anchor"), "again")
    mixed = again.where(~F.col("alike"))
    classes = written(mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"), F.min(F.struct("doc_id", "tie", "start")).alias("one")).select("anchor", "context", "n", "windows", "one.*"), "classes")
    # all contexts travel, as those that occur once may share windows with those that occur more often
    texts = _contexts(long_, bloom(classes.select("doc_id", "tie", "start"), lambda batch: _place(*[batch.column(i).to_numpy() for i in range(3)])))
    many = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    marked = classes.select("anchor", "context", (F.col("n") > 1).alias("whole"))
    any_hot = not many.isEmpty()
    if any_hot:
        marked = written(marked.join(many, "anchor", "left"), "marked")
    members = texts.join(marked, ["anchor", "context"])
    if any_hot:
        members = written(members, "contexts")
        hot_ones = members.where("hot").groupBy("anchor", "context").agg(F.any_value("whole").alias("whole"), F.any_value("bytes").alias("bytes"))
        more = _split(hot_ones, hot)
        members = members.where("hot is null")
    part = _settled_plain(members.select(F.col("anchor").alias("group"), F.col("context").alias("member"), "whole", "bytes"))
    part = part.unionByName(more) if any_hot else part
    whole = classes.where("n > 1").select(F.col("anchor").alias("group"), F.col("context").alias("member"), F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))).alias("spans"))
    ranges = written(whole.unionByName(part).toDF("anchor", "context", "spans"), "ranges")
    partly = mixed.join(ranges, ["anchor", "context"]).select("doc_id", "tie", "start", F.explode("spans").alias("x"))
    partly = partly.select("doc_id", "tie", (F.col("start") + F.col("x.first")).alias("start"), (F.col("start") + F.col("x.last") + LEAST).alias("end"))
    return again.where("alike").select("doc_id", "tie", "start", (F.col("start") + F.col("windows") - 1 + LEAST).alias("end")).unionByName(partly)


def _settled_plain(members: DataFrame) -> DataFrame:
    """`_settled` where no group is hot."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_expand_intervals, _RANGE)


def _cut(text: str, found: list) -> tuple[bytes, int, int, int]:
    """What is left of the text's bytes, how many there were, how many go and in how many runs."""
    data = text.encode("utf-8", "surrogatepass")
    if not found:
        return data, len(data), 0, 0
    merged: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in found):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    edges = [0, *[x for m in merged for x in m], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(data), sum(e - s for s, e in merged), len(merged)


def _with_spans(rows: DataFrame, hot: int) -> DataFrame:
    found = spans(rows, hot).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    return found.select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie"), "__spans")


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                out = [_cut(t or "", f) for t, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)], pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, keyed = _with_spans(docs, hot), _keyed(docs)
    joined = keyed.withColumn("id", F.col("doc_id")).join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("tie") == F.col("__tie")), "left")
    out = joined.select(F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "text", "__spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents without the repeated passages; those of which nothing is left go. n_chars follows the text."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = [_cut(t or "", f)[0].decode("utf-8", "ignore") for t, f in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(columns))], columns)

    found = _with_spans(docs, hot)
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(found, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col("__doc")) & (F.xxhash64(text) == F.col("__tie")), "left")
    out = joined.select(*columns, "__spans").mapInArrow(run, docs.schema).where(F.trim("text") != "")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_array_dedup": op10}
