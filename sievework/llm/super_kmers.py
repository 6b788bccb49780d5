"""Operator 12: dedup of passages of at least 50 words, by super-k-mers.

A window is 50 consecutive words of one document, a gram some consecutive words in it. A window's minimiser is its gram of
least hash; equal windows have equal minimisers at equal places. Consecutive windows with one minimiser form a
super-k-mer, whose words travel as one packed string to the minimiser's bucket.

1. Minimisers are counted by document. One that stands in a single document repeats nothing.
2. Super-k-mers of the others, without their words yet, become classes of equal strings (minimiser and 128-bit digest), so
   a passage that stands in many documents travels once. A minimiser of one class needs no sorting.
3. One string of each class of the other minimisers goes to the bucket. There windows are sorted exactly: words become
   numbers, and ranks of 1, 2, 4 .. 32 words are sorted in pairs until they rank windows of 50. Each window gets the least
   doc_id that has it.
4. Ranges of windows go back to all super-k-mers of their class, where windows of a smaller doc_id remove their words.

A bucket of more than `HOT` classes isn't held by one task: its strings are cut again by the minimisers of longer grams
(`GRAMS`), which differ where the windows do, down to the window itself, which Spark groups by its bytes. The result is
the same with any `HOT`.

Null texts are empty. Texts of fewer than 50 words repeat nothing. A null doc_id counts as the least. Rows that share a
doc_id don't remove each other, but each is removed by smaller ones. Texts of any length are taken whole, some megabytes
at a time with 49 words in common. An empty table gives an empty result. `digests` reads no other columns; `remove` keeps
them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bloom import bloom, known, mix
from sievework.llm.common import dropped, table, utf8_batches, written

WINDOW = 50
#: Words of a gram by level; the last level's gram is the window.
GRAMS = (8, 29, WINDOW)
HOT = 2000
#: Bytes of text taken at once, of a long text, and packed bytes sorted at once.
BATCH, SEGMENT, SORTED = 1_000_000, 4_000_000, 1_000_000

_MULT = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(271828).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NO_ID = -(2**63)


def _hashes(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of t[start:end] for each pair, the same wherever the values stand."""
    power = np.multiply.accumulate(np.full(len(t) + 1, _MULT, np.uint64))
    back = np.multiply.accumulate(np.full(len(t) + 1, pow(_MULT, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * power[: len(t)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * back[start])


class Words:
    """Words of some texts: each one's bytes lie at `start`:`end` of `data`, where one space parts the words of a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        raw = np.full(len(data) + len(sizes), 32, np.uint8)  # a space ends each text
        raw[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        space = _SPACE[raw]
        first = ~space & np.r_[True, space[:-1]]
        self.raw_start = np.flatnonzero(first)
        keep = ~space | np.r_[False, ~space[:-1]]
        self.data = np.where(space[keep], np.uint8(32), raw[keep])
        self.end = np.flatnonzero(self.data == 32)
        self.start = np.r_[0, self.end[:-1] + 1].astype(np.int64)[: len(self.end)]
        upto = np.r_[0, np.cumsum(first)]
        self.count = upto[offsets[1:] + np.arange(1, len(offsets))] - upto[offsets[:-1] + np.arange(len(sizes))]
        self.text = np.repeat(np.arange(len(sizes)), self.count)
        self.before = np.r_[0, np.cumsum(self.count)[:-1]].astype(np.int64)

    def hashes(self) -> np.ndarray:
        return _hashes(_BYTES[self.data], self.start, self.end)

    def packed(self, first: int, windows: int) -> bytes:
        return self.data[self.start[first] : self.end[first + windows + WINDOW - 2]].tobytes()


def super_kmers(words: Words, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one minimiser: text, first word (`first` of all words), `windows` and `anchor`."""
    n, span = len(words.text), WINDOW - gram + 1
    count = n - WINDOW + 1
    window = np.flatnonzero(words.text[:count] == words.text[WINDOW - 1 :]) if count > 0 else np.zeros(0, np.int64)
    if not len(window):
        return {k: np.zeros(0, np.int64) for k in ("text", "first", "windows", "anchor")}
    place = np.arange(n - gram + 1)
    h = _hashes(words.hashes(), place, place + gram)
    # hash above, place below: minima are the leftmost of equals
    key = (h & np.uint64(2**64 - 2**24)) | place.astype(np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & np.uint64(2**24 - 1)).astype(np.int64)[window]
    text = words.text[window]
    start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    return {"text": text[start], "first": window[start], "windows": np.diff(np.r_[start, len(window)]), "anchor": h[at[start]].view(np.int64)}


def _pieces(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[Words, int]]:
    """The words of a batch of texts, or of a long text piece by piece, with the number of words before."""
    if len(offsets) > 2 or len(data) <= 2 * SEGMENT:
        yield Words(data, offsets), 0
        return
    start = before = 0
    size = SEGMENT
    while True:
        end = min(start + size, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        words = Words(data[start:end], np.array([0, end - start]))
        again = len(words.text) - (WINDOW - 1)
        if again <= 0 and end < len(data):  # words of such a length that no window fits
            size *= 2
            continue
        yield words, before
        if end == len(data):
            return
        start, before = start + int(words.raw_start[again]), before + again


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long (null: the least one), a hash of the text that parts rows of one id, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in utf8_batches(batches, "text", BATCH):
        for words, _ in _pieces(part, data, offsets):
            r = super_kmers(words, GRAMS[0])
            both = np.unique(np.stack([r["anchor"], part.column(0).to_numpy()[r["text"]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["anchor", "doc_id"])


_RUN = "doc_id long, tie long, start long, windows int, anchor long, member binary"


def _runs(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """Super-k-mers whose minimiser the filter knows."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in utf8_batches(batches, "text", BATCH):
            for words, before in _pieces(part, data, offsets):
                r = super_kmers(words, GRAMS[0])
                r = {k: v[hit] for hit in [known(shared.value, r["anchor"])] for k, v in r.items()}
                member = [xxhash.xxh3_128_digest(words.packed(a, w)) for a, w in zip(r["first"], r["windows"], strict=True)]
                doc, tie = (part.column(i).to_numpy()[r["text"]] for i in (0, 1))
                start = r["first"] - words.before[r["text"]] + before
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(start), pa.array(r["windows"], pa.int32()), pa.array(r["anchor"]), pa.array(member, pa.binary())], ["doc_id", "tie", "start", "windows", "anchor", "member"])

    return keyed.mapInArrow(run, _RUN)


def _place(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * np.uint64(_MULT) + mix(tie.view(np.uint64) + mix(start.astype(np.uint64)))).view(np.int64)


def _strings(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """(anchor, member, bytes) of the super-k-mers at (doc_id, tie, start), and perhaps of some more."""
    shared = keyed.sparkSession.sparkContext.broadcast(bloom(places, lambda batch: _place(*[batch.column(i).to_numpy() for i in range(3)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in utf8_batches(batches, "text", BATCH):
            doc, tie = (part.column(i).to_numpy() for i in (0, 1))
            for words, before in _pieces(part, data, offsets):
                r = super_kmers(words, GRAMS[0])
                start = r["first"] - words.before[r["text"]] + before
                at = np.flatnonzero(known(shared.value, _place(doc[r["text"]], tie[r["text"]], start)))
                texts = [words.packed(r["first"][i], r["windows"][i]) for i in at]
                member = [xxhash.xxh3_128_digest(x) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(r["anchor"][at]), pa.array(member, pa.binary()), pa.array(texts, pa.binary())], ["anchor", "member", "bytes"])

    return keyed.mapInArrow(run, "anchor long, member binary, bytes binary")


_RANGES = "array<struct<first:int,last:int,doc:long>>"
_FOUND = f"group long, member binary, ranges {_RANGES}"


def least_documents(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, least doc) of each window of each string, in order; a window's documents are those of all strings with it.

    Words are numbered, then ranks of twice as many words follow from sorted pairs of ranks: equality is exact.
    """
    lists = [s.split(b" ") for s in strings]
    size = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), size)
    rank = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    length = 1
    while length < WINDOW:
        step = min(length, WINDOW - length)
        _, rank = np.unique(rank[: len(rank) - step] * (rank.max() + 1) + rank[step:], return_inverse=True)
        length += step
    inside = np.flatnonzero(owner[: len(rank)] == owner[WINDOW - 1 :])
    rank, owner = rank[inside], owner[inside]
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0])
    least = np.empty(len(rank), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], starts), np.diff(np.r_[starts, len(order)]))
    return owner, least


def _range_batch(group: list, member: list, first: list, most: list, strings: list[bytes]) -> pa.RecordBatch:
    """Of each string the ranges of windows with a document less than its greatest, each with the least such document."""
    owner, least = least_documents(strings, np.array(first, np.int64))
    at = np.arange(len(owner)) - np.searchsorted(owner, owner)
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
    last = np.r_[start[1:], len(owner)] - 1
    asked = least[start] < np.array(most, np.int64)[owner[start]]
    start, last = start[asked], last[asked]
    has, count = np.unique(owner[start], return_counts=True)
    ranges = pa.StructArray.from_arrays([pa.array(at[start], pa.int32()), pa.array(at[last], pa.int32()), pa.array(least[start])], ["first", "last", "doc"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), ranges)
    return pa.RecordBatch.from_arrays([pa.array([group[i] for i in has], pa.int64()), pa.array([member[i] for i in has], pa.binary()), lists], ["group", "member", "ranges"])


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets together, some at a time; rows come sorted by group."""
    held: list[list] = [[] for _ in range(5)]
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if size > SORTED and row[0] != held[0][-1]:
                yield _range_batch(*held)
                held, size = [[] for _ in range(5)], 0
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[4])
    if size:
        yield _range_batch(*held)


def _cut(gram: int):
    """Strings of a hot bucket cut by the minimisers of longer grams: rows (group, member, first, most, at, next, kind, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                strings = part.column(4).to_pylist()
                words = Words(np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum([len(x) for x in strings])])
                r = super_kmers(words, gram)
                rows = pa.array(r["text"])
                texts = [words.packed(a, w) for a, w in zip(r["first"], r["windows"], strict=True)]
                near = mix(r["anchor"].view(np.uint64) ^ part.column(0).to_numpy().view(np.uint64)[r["text"]]).view(np.int64)
                kind = [xxhash.xxh3_128_digest(x) for x in texts]
                at = pa.array(r["first"] - words.before[r["text"]], pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(rows) for i in range(4)], at, pa.array(near), pa.array(kind, pa.binary()), pa.array(texts, pa.binary())], ["group", "member", "first", "most", "at", "next", "kind", "bytes"])

    return run


def _least(members: DataFrame, hot: int, level: int) -> DataFrame:
    """(group, member, ranges) of members (group, member, first, most, bytes), each once."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("group", F.lit(True).alias("hot")), "hot")
    if many.isEmpty():
        few, more = members, None
    else:
        marked = written(members.join(many, "group", "left"), "marked")
        few, more = marked.where("hot is null"), _least_of_hot(marked.where("hot"), hot, level + 1)
    found = few.select("group", "member", "first", "most", "bytes").repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_sort_windows, _FOUND)
    return found if more is None else found.unionByName(more)


def _least_of_hot(members: DataFrame, hot: int, level: int) -> DataFrame:
    rows = members.select("group", "member", "first", "most", "bytes").mapInArrow(_cut(GRAMS[level]), "group long, member binary, first long, most long, at int, next long, kind binary, bytes binary")
    rows = written(rows, "cut")
    if GRAMS[level] == WINDOW:  # a row is a window
        # written, so that a window of very many strings is dealt over several tasks
        least = written(rows.groupBy("bytes").agg(F.min("first").alias("doc"), F.max("most").alias("greatest")).where("doc < greatest").drop("greatest"), "windows")
        moved = rows.join(least, "bytes").where("doc < most").select("group", "member", F.struct(F.col("at").alias("first"), F.col("at").alias("last"), "doc").alias("range"))
    else:
        kinds = written(rows.groupBy("next", "kind").agg(F.min("first").alias("first"), F.max("most").alias("most"), F.any_value("bytes").alias("bytes")), "kinds")
        found = written(_least(kinds.select(F.col("next").alias("group"), F.col("kind").alias("member"), "first", "most", "bytes"), hot, level), "least")
        found = found.select(F.col("group").alias("next"), F.col("member").alias("kind"), F.explode("ranges").alias("x"))
        moved = rows.join(found, ["next", "kind"]).where("x.doc < most")
        moved = moved.select("group", "member", F.struct((F.col("x.first") + F.col("at")).alias("first"), (F.col("x.last") + F.col("at")).alias("last"), F.col("x.doc").alias("doc")).alias("range"))
    # a string has as many windows as a gram's places at most
    return moved.groupBy("group", "member").agg(F.collect_list("range").alias("ranges"))


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, tie, start, end): words that a window of a smaller doc_id covers; spans may overlap."""
    long_ = _keyed(docs).where(F.octet_length("text") >= 2 * WINDOW - 1)
    anchors = long_.mapInArrow(_anchors, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = written(anchors.where("low < high").select("anchor"), "minimisers")
    # written, so that runs of hot minimisers are dealt over several tasks
    again = written(_runs(long_, bloom(anchors)).join(anchors, "anchor"), "super_kmers")
    dropped(anchors)
    classes = again.groupBy("anchor", "member").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"), F.max("windows").alias("windows"), F.min(F.struct("doc_id", "tie", "start")).alias("one"))
    classes = written(classes, "classes")
    several = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "several")
    mixed = written(classes.join(several, "anchor", "left_semi").select("anchor", "member", "first", "most", "one.*"), "mixed")
    strings = _strings(long_, mixed.select("doc_id", "tie", "start")).join(mixed.select("anchor", "member", "first", "most"), ["anchor", "member"]).dropDuplicates(["anchor", "member"])
    strings = written(strings, "strings")
    sorted_ = _least(strings.select(F.col("anchor").alias("group"), "member", "first", "most", "bytes"), hot, 0).toDF("anchor", "member", "ranges")
    alike = classes.where("first < most").join(several, "anchor", "left_anti")
    alike = alike.select("anchor", "member", F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"), F.col("first").alias("doc"))).cast(_RANGES).alias("ranges"))
    ranges = written(alike.unionByName(sorted_), "ranges")
    found = again.join(ranges, ["anchor", "member"]).select("doc_id", "tie", "start", F.explode("ranges").alias("x")).where("x.doc < doc_id")
    return found.select("doc_id", "tie", (F.col("start") + F.col("x.first")).alias("start"), (F.col("start") + F.col("x.last") + WINDOW).alias("end"))


def _with_spans(docs: DataFrame, hot: int) -> DataFrame:
    found = spans(docs, hot).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    return found.select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie"), "__spans")


def _kept(text: str, found: list) -> Iterator[tuple[int, list[bytes]]]:
    """Piece by piece: how many words it has, and those that no span covers."""
    data, start, before = text.encode("utf-8", "surrogatepass"), 0, 0
    edges = np.array(sorted((x["start"], x["end"]) for x in found), np.int64).reshape(-1, 2)
    while start < len(data):
        end = start + SEGMENT
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        words = data[start:end].split()
        low, high = np.clip(edges - before, 0, len(words)).T
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, low, 1)
        np.add.at(cover, high, -1)
        yield len(words), [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)] if len(edges) else words
        start, before = end, before + len(words)


def _digest(text: str, found: list) -> tuple[int, int, str]:
    sha, n, left = hashlib.sha256(), 0, 0
    for count, words in _kept(text, found):
        if words:
            sha.update((b" " if left else b"") + b" ".join(words))
        n, left = n + count, left + len(words)
    return n, n - left, sha.hexdigest()


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that are left, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                out = [_digest(t.as_py(), f.as_py() or []) for t, f in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found, keyed = _with_spans(docs, hot), _keyed(docs)
    joined = keyed.join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("tie") == F.col("__tie")), "left")
    return joined.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "__spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents; where words go, the others are joined by a space. Documents of which nothing is left stay, empty."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = [b" ".join(w for _, words in _kept(t, f) for w in words).decode("utf-8", "ignore") if f else t for t, f in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(columns))], columns)

    found = _with_spans(docs, hot)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__tie"))
    out = docs.join(found, same, "left").select(*columns, "__spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_super_kmers": op12}

ORACLE_SQL = {
    "op12_super_kmers": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT row, doc_id, len(words) AS n, unnest(range(1, len(words) - 48)) AS pos, words FROM d WHERE len(words) >= 50),
s AS MATERIALIZED (SELECT row, doc_id, pos, array_to_string(words[pos : pos + 49], ' ') AS win FROM w),
gone AS (SELECT row, pos FROM s JOIN (SELECT win, min(doc_id) AS least FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)) m USING (win) WHERE least < doc_id),
word AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
marked AS (SELECT word.row, word.pos, word.word, count(gone.pos) OVER (PARTITION BY word.row ORDER BY word.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS cut FROM word LEFT JOIN gone ON gone.row = word.row AND gone.pos = word.pos),
left_ AS (SELECT row, count(*) AS n_words, count(*) FILTER (cut) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT cut) AS kept FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (row)"""
}
