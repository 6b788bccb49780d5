"""Operator 7: document fingerprints as Merkle trees over sections and paragraphs.

A text is cut into paragraphs at line ends and paragraphs into sections at blank lines or after a paragraph
whose hash asks for it, so that an edit moves no boundary far away from it. The leaves below a paragraph are
runs of words that end where a word's hash asks for it; a leaf's hash covers its bytes. Every inner node hashes
its children, the root all of the text: equal roots mean equal texts, and where roots differ, the branches whose
hashes differ lead to the edit (`diff`).

A fingerprint is one string: root, then the sections, each with its paragraphs, each with its leaves' hashes and
sizes. `likeness` is the share of code points in leaves that two fingerprints have in common.

Nulls: a null text is the empty text, whose tree has no leaf; two empty texts are alike to 1.0, an empty and
another one to 0.0. Ties of doc_id are ordered by the text; the document after the last one is the first.
With one document only, it follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import table, texts_of

#: One word in so many ends a leaf; one paragraph in so many ends a section.
LEAF_WORDS, SECTION_PARAGRAPHS = 6, 8
_WORD = re.compile(r"\S+\s*|\s+")


def _hash(data: bytes) -> str:
    return b64encode(hashlib.blake2b(data, digest_size=6).digest()).decode()


def _leaves(paragraph: str) -> list[str]:
    """The hash and size of each leaf, as `hash.size`."""
    out, held = [], []
    for word in _WORD.findall(paragraph):
        held.append(word)
        if not crc32(word.encode("utf-8", "surrogatepass")) % LEAF_WORDS:
            leaf = "".join(held)
            out.append(f"{_hash(leaf.encode('utf-8', 'surrogatepass'))}.{len(leaf)}")
            held = []
    if held:
        leaf = "".join(held)
        out.append(f"{_hash(leaf.encode('utf-8', 'surrogatepass'))}.{len(leaf)}")
    return out


def fingerprint(text: str) -> str:
    """`root;section(paragraph[leaf.size,...],...),...`: 32 hex digits, then hashes of 6 bytes."""
    sections, held = [], []
    for line in text.splitlines(keepends=True) if text else []:
        leaves = ",".join(_leaves(line))
        own = _hash(leaves.encode())
        held.append(f"{own}[{leaves}]")
        if line.isspace() or not crc32(own.encode()) % SECTION_PARAGRAPHS:
            sections.append(held)
            held = []
    if held:
        sections.append(held)
    body = ",".join(f"{_hash('|'.join(x[:8] for x in s).encode())}({','.join(s)})" for s in sections)
    root = hashlib.blake2b(body.encode() + hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest(), digest_size=16)
    return f"{root.hexdigest()};{body}"


_LEAF = re.compile(r"[\[,]([A-Za-z0-9+/]{8})\.(\d+)")
_TREE = re.compile(r"([A-Za-z0-9+/]{8})([(\[.])")


def leaves(print_: str) -> Counter:
    """How many code points stand in leaves of each hash."""
    out: Counter = Counter()
    for h, n in _LEAF.findall(print_):
        out[h] += int(n)
    return out


def likeness(a: str, b: str) -> float:
    if a[:32] == b[:32]:
        return 1.0
    x, y = leaves(a), leaves(b)
    total = x.total() + y.total()
    return min(1.0, 2 * sum((x & y).values()) / total) if total else 0.0


def diff(a: str, b: str) -> list[tuple[int, int]]:
    """Where two texts differ: [start, end) in code points of the first, branch by branch."""
    if a[:32] == b[:32]:
        return []
    there, out, at = set(h for h, _ in _LEAF.findall(b)), [], 0
    sections = {h for h, kind in _TREE.findall(b) if kind == "("}
    for section in re.findall(r"([A-Za-z0-9+/]{8})\(((?:[^()])*)\)", a[33:]):
        found = [(h, int(n)) for h, n in _LEAF.findall(section[1])]
        for h, n in found:
            if section[0] not in sections and h not in there:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + n)
                else:
                    out.append((at, at + n))
            at += n
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = texts_of(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def _firsts(docs: DataFrame, part_bytes: int) -> np.ndarray:
    """The first doc_id of each range of documents with about `part_bytes` of text, ascending."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange(parts, "doc_id")
    got = slim.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first")).select("first").toPandas()["first"]
    return np.unique(got.dropna().to_numpy(np.int64))


def edited_fingerprints(docs: DataFrame, part_bytes: int = 16_000_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the beginning of the next document.

    The texts travel once, to ranges of doc_id; the first document of a range goes to the range before as well
    (and the very first to the last range), so each range has all that its documents need.
    """
    firsts = _firsts(docs, part_bytes)
    last = max(0, len(firsts) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(firsts, ids, side="right") - 1, 0)
            text = batch.column(1).fill_null("")
            edge = np.flatnonzero((firsts[part] == ids) if len(firsts) else np.ones(len(ids), bool))
            for at, to, tail in ((slice(None), part, False), (edge, np.where(part[edge] > 0, part[edge] - 1, last), True)):
                if len(to):
                    rows = pa.array(np.arange(len(ids))[at])
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([tail] * len(to)), batch.column(0).take(rows), text.take(rows)], ["part", "tail", "doc_id", "text"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for batch in batches:
            for part, tail, doc, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held is not None and held[0] == part:
                    own = fingerprint(text)
                    half = len(held[2]) // 2
                    edited = held[2][: len(held[2]) - half] + text[:half]
                    other = fingerprint(edited)
                    out.append((held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], own)))
                    size += len(held[2])
                    held = None if tail else (part, doc, text, own)
                elif not tail:
                    held = (part, doc, text, fingerprint(text))
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    kind = "doc_id long"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, f"part int, tail boolean, {kind}, text string")
    # the ranges are even by their making; by a hash, several would meet in one task
    ranged = dealt.repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")
    return ranged.mapInArrow(chain, f"{kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _COLUMNS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_document_fingerprints": op7}
