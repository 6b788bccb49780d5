"""Operator 2: best-fit packing of token sequences by exact complements.

Only the counts of the pieces' lengths (at most `capacity` numbers) reach the driver. There, gaps are filled
exactly by single lengths, then by sums of pairs and of triples that are still available, many sequences of
one pattern at once; what is left is packed best-fit, longest first. A pattern with its number of sequences
gives each length ranges of ranks, so a piece finds its sequence and offset from its rank among the pieces of
its length. The table of ranges depends on the capacity, not on the data's size.

Nulls: a null text is empty and holds the end token only. Only documents longer than the capacity are cut: the
first piece takes the remainder. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import gapless, table, texts_of, written

CAPACITY, END = 1024, 2
KEPT = 400_000
ROWS_PER_BUCKET = 5_000
#: White space that would meet a space at a chunk's border, where a chunk no longer stands alone.
_MIXED = re.compile(r" \s|[^\S ] |\A\s|\s\Z")
#: Letters whose classes all pattern engines agree on.
_PLAIN = re.compile("[\0-ɏ]*\\Z")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by chunks between single spaces.

    A chunk's ids don't depend on its neighbours: pre-tokens never reach over the border before a space. Chunks
    that are kept are looked up, others go to a rank-based encoder of the same vocabulary; texts with other
    white space at spaces, special tokens or unusual letters go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        if self.fast is not None and _PLAIN.match(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return self.slow(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _MIXED.search(text) or any(s in text for s in self.special):
            return self.slow(text)
        head, *rest = text.split(" ")
        later, out = self.later, []
        try:
            out = [later[c] for c in rest]
        except KeyError:
            room = len(later) < KEPT
            for c in rest:
                ids = later.get(c)
                if ids is None:
                    ids = self.chunk(" " + c)
                    if room:
                        later[c] = ids
                out.append(ids)
        ids = self.first.get(head)
        if ids is None:
            ids = self.chunk(head)
            if len(self.first) < KEPT // 4:
                self.first[head] = ids
        return ids + b"".join(out)


def pieces(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the piece's ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = None, np.array([end], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or Encoder(path, ranks)
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                row, made = [], []
                for i, text in enumerate(texts_of(part)):
                    raw = encoder.encode(text) + tail
                    n = len(raw) // 4
                    start, stop = 0, n % capacity or capacity
                    piece = 0
                    while start < n:
                        cut = raw[4 * start : 4 * stop]
                        made.append((piece, start, stop - start, crc32(cut), np.frombuffer(cut, "<u4").tolist() if ids else None))
                        row.append(i)
                        piece, start, stop = piece + 1, stop, stop + capacity
                doc = part.column(part.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([doc, *[pa.array([m[j] for m in made], kinds[j]) for j in range(4 + ids)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Multisets of lengths and how many sequences hold each, for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> bool:
        """As many sequences of these lengths as there are pieces for."""
        need = Counter(lengths)
        m = min(int(left[n]) // k for n, k in need.items())
        if m <= 0:
            return False
        for n, k in need.items():
            left[n] -= m * k
        out.append((lengths, m))
        return True

    take(capacity)
    for a in range(capacity - 1, capacity // 2 - 1, -1):
        take(a, capacity - a)
    for a in range(capacity - 2, 0, -1):
        _complete(take, left, capacity, (a,))
    for a in range(capacity - 3, 0, -1):
        if left[a]:
            for b in np.flatnonzero(left[: min(a, capacity - a - 2) + 1])[::-1].tolist():
                if not left[a]:
                    break
                if left[b]:
                    _complete(take, left, capacity, (a, b))
    return out + _best_fit(left, capacity)


def _complete(take, left: np.ndarray, capacity: int, begun: tuple[int, ...]) -> None:
    """Fill the gap that `begun` leaves with pairs whose sum it is."""
    gap = capacity - sum(begun)
    low = np.arange(1, gap // 2 + 1)
    for b in low[(left[low] > 0) & (left[gap - low] > 0)][::-1].tolist():
        if not all(left[n] for n in begun):
            return
        take(*begun, gap - b, b)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest sequence with room, all pieces of a length together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    gaps: list[int] = []
    for n in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[n])
        while rest:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                k = capacity // n
                full, rest = divmod(rest, k)
                for lengths, m in (((n,) * k, full), ((n,) * rest, int(rest > 0))):
                    if m:
                        _put(open_, gaps, capacity - sum(lengths), lengths, m)
                rest = 0
            else:
                gap = gaps[at]
                held, m = open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(at)
                k = gap // n  # so many fit into each
                whole = min(m, rest // k)
                if whole:
                    _put(open_, gaps, gap - k * n, held + (n,) * k, whole)
                    rest -= whole * k
                if m > whole:
                    if 0 < rest < k:
                        _put(open_, gaps, gap - rest * n, held + (n,) * rest, 1)
                        whole, rest = whole + 1, 0
                    if m > whole:
                        _put(open_, gaps, gap, held, m - whole)
    return [x for rows in open_.values() for x in rows]


def _put(open_: dict, gaps: list[int], gap: int, lengths: tuple[int, ...], m: int) -> None:
    if not open_[gap]:
        gaps.insert(bisect_left(gaps, gap), gap)
    open_[gap].append((lengths, m))


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: for each its length, first rank, first sequence and offset; sorted by length and rank."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for lengths, m in found:
        offset = 0
        for n in lengths:
            rows.append((n, ranks[n], sequence, offset))
            ranks[n] += m
            offset += n
        sequence += m
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T.copy(), strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (as of `pieces`) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = places(patterns(counts, capacity))
    key = (at["length"] << 44) + at["rank"]
    buckets = min(4096, max(counts.values(), default=0) // ROWS_PER_BUCKET + 1)
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], buckets, "rank")
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(at["sequence"][row] + rank - at["rank"][row]), pa.array(at["offset"][row])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False)
    return pack(written(cut, "pieces"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2}
