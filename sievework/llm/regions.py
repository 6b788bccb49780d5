"""Regions of a metric-space join, for both similarity joins: pivots inside each region, then what is left between components.

Rows are (region, rep, size, cells): a member of a region with a short signature (`CELLS` counts in a byte each).
Every link has a region that holds both of its ends. `near` tells of the signatures of two sets of members which pairs
may link; it never denies a link.

1. Regions of more than `BLOCK` members are dealt into blocks by hash. In each block members are chosen as pivots,
   those with most open neighbours first, and each pivot takes its open neighbours as its Voronoi cell (`cover`). The
   pivots of a large region meet in a next round, with at most half as many members.
2. Pivots are verified with the members of their cells, which gives components.
3. Regions whose members are in one component are done. In the others, blocks meet in pairs and only pairs between
   components that the signatures can't part are emitted and verified.

No step sends a pair of members with their signatures: a block's signatures meet in one task of numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import dropped, written
from sievework.llm.graph import components

BLOCK, CELLS = 512, 128
ROWS = "region long, rep long, size long, cells binary"
#: Signatures and sizes of some members, and of some others: whether each two may link.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def once(members: DataFrame) -> DataFrame:
    """(region, members): one region of each set of members, as the others would repeat its work. With `chars` also their `room`."""
    room = [F.sum("chars").alias("room")] if "chars" in members.columns else []
    same = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"), *room).where("members > 1")
    return same.groupBy("members", "who").agg(F.min("region").alias("region"), *[F.any_value("room").alias("room") for _ in room]).drop("who")


def shared_counts(x: np.ndarray, y: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the cells of `of` for each two rows of x and y."""
    if len(x) * len(y) <= 4096:
        return of(x[:, None, :], y[None, :, :]).sum(-1, dtype=np.int32)
    out = np.zeros((len(x), len(y)), np.int32)
    for c in range(x.shape[1]):
        out += of(x[:, c, None], y[None, :, c])
    return out


def cover(mask: np.ndarray) -> list[tuple[int, int]]:
    """(pivot, member): pivots by their open neighbours, each taking these; whoever stays open is tied to a neighbour."""
    open_ = mask.any(1)
    live = mask.sum(1)
    out: list[tuple[int, int]] = []
    while True:
        p = int(np.argmax(np.where(open_, live, 0)))
        if not open_[p] or not live[p]:
            break
        near = np.flatnonzero(mask[p] & open_)
        out += [(p, int(x)) for x in near]
        gone = np.append(near, p)
        open_[gone] = False
        live = live - mask[:, gone].sum(1)
    return out + [(int(np.argmax(mask[x])), int(x)) for x in np.flatnonzero(open_)]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of each group of the first `keys` columns; rows come sorted by them, groups have some hundreds of rows."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield last, _joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cells(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16)


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _covers(rows: DataFrame, near: Near) -> DataFrame:
    """(region, a, b) with pivot a of each member b, for rows with their region's `members`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []
        for (region, _), part in groups(batches, 2):
            rep, size, cells = part.column(2).to_numpy(), part.column(3).to_numpy(), _cells(part, 4)
            mask = near(cells, size, cells, size)
            mask &= rep[:, None] != rep[None, :]
            found += [(region, int(rep[p]), int(rep[x])) for p, x in cover(mask)]
            if len(found) > 10_000:
                yield _triples(found)
                found = []
        yield _triples(found)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK)).alias("block")
    dealt = rows.select("region", block, "rep", "size", "cells").repartition(parts, "region", "block").sortWithinPartitions("region", "block")
    return dealt.mapInArrow(run, "region long, a long, b long")


def _triples(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(3)], ["region", "a", "b"])


def _between(rows: DataFrame, near: Near) -> DataFrame:
    """(a, b) of different roots that may link, of rows with `root` and `members`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), part in groups(batches, 3):
            rep, size, cells, root, block = part.column(3).to_numpy(), part.column(4).to_numpy(), _cells(part, 5), part.column(6).to_numpy(), part.column(7).to_numpy()
            x, y = block == i, block == j
            mask = near(cells[x], size[x], cells[y], size[y]) & (root[x][:, None] != root[y][None, :])
            a, b = np.nonzero(mask)
            if i == j:
                a, b = a[a < b], b[a < b]
            yield pa.RecordBatch.from_arrays([pa.array(rep[x][a]), pa.array(rep[y][b])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "size", "cells", "root", "block")
    return dealt.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(run, "a long, b long")


def connect(rows: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the members that links connect. rows have their region's number of `members`.

    verify: the pairs (a, b) of those given that link.
    """
    rows = written(rows.select("region", "rep", "size", "cells", "members"), "members")
    current, stars = rows, None
    while True:
        found = written(_covers(current, near), "stars")
        stars = found if stars is None else stars.unionByName(found)
        large = current.where(F.col("members") > BLOCK)
        pivots = found.join(large.select("region").distinct(), "region", "left_semi").select("region", F.col("a").alias("rep")).distinct()
        many = pivots.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        current = written(large.drop("members").join(pivots, ["region", "rep"], "left_semi").join(many, "region"), "pivots")
        if current.isEmpty():
            break
    pairs = written(_pairs(stars), "pairs")
    links = written(verify(pairs), "links")
    tied = components(links)
    tied = tied.withColumnRenamed("node", "rep")
    root = F.coalesce("root", "rep").alias("root")
    of = rows.select("region", "rep").join(tied, "rep", "left").select("region", root)
    several = of.groupBy("region").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("region")
    apart = rows.join(several, "region").join(tied, "rep", "left").select("region", "rep", "size", "cells", "members", root)
    rest = written(_pairs(_between(apart, near)).join(pairs, ["a", "b"], "left_anti"), "rest")
    dropped(rows, current, found, pairs)
    if rest.isEmpty():
        return tied.withColumnRenamed("rep", "node")
    more = written(verify(rest), "more")
    out = components(links.unionByName(more))
    dropped(links, rest, more)
    return out
