"""Vector search: exact cosine top-k in query blocks, LSH, int8 codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.models import dot, l2


def unit(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", l2(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


#: Queries and vectors of one block product, the least number of blocks that vectors are cut into, and queries at a time.
BLOCK, VECTORS, LEAST, TILE = 4096, 65_536, 64, 64
#: Scores of a product that lie this near to a query's k-th best are worked out again, term by term.
SLACK = 1e-8

_NEAR = "query long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray, dtype=float) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(flat), -1)


def _nearest(k: int, coded: bool) -> Callable[[pa.Table], pa.Table]:
    """Of one block: each query's k best vectors by the product or, if coded, by distance among those that share a code.

    The product only finds what may be among the best; scores are sums in the order of the components, as `dot` adds.
    """

    def run(rows: pa.Table) -> pa.Table:
        asking = rows["asked"].to_numpy(zero_copy_only=False).astype(bool)
        q, of = rows.filter(pa.array(asking)), rows.filter(pa.array(~asking))
        query, ids = q["vec_id"].to_numpy(), of["vec_id"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        x, v = (_matrix(t["v"]) if len(t) else None for t in (q, of))
        codes = [_matrix(t["codes"], np.int64) if coded and len(t) else None for t in (q, of)]
        for s in range(0, len(query) if len(ids) else 0, TILE):
            tile, here = x[s : s + TILE], query[s : s + TILE]
            score = tile @ v.T
            if coded:
                score = 2 * score - (v * v).sum(1)  # falls as the distance grows
                mine, theirs = codes[0][s : s + TILE], codes[1]
                shared = np.zeros(score.shape, bool)
                for t in range(mine.shape[1]):
                    shared |= mine[:, t][:, None] == theirs[:, t][None]
                score[~shared] = -np.inf
            score[here[:, None] == ids[None]] = -np.inf
            least = score.min(1) if len(ids) <= k else np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            row, column = np.nonzero((score >= least[:, None] - SLACK * np.maximum(1, np.abs(least))[:, None]) & (score > -np.inf))
            exact = np.zeros(len(row))
            for d in range(x.shape[1]):
                a, b = v[column, d], tile[row, d]
                exact += (a - b) ** 2 if coded else a * b
            exact = -np.sqrt(exact) if coded else exact
            order = np.lexsort((ids[column], -(exact if coded else np.round(exact, 9)), row))
            row, column, exact = row[order], column[order], exact[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((here[row[kept]], ids[column[kept]], exact[kept]))
        return pa.table(dict(zip(("query", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, block: int, cell: bool = False, coded: bool = False) -> DataFrame:
    """(query, vec_id, score): the k best of each block of vectors for each query. With `cell` only rows of one cell meet.

    A vector travels once for every `block` queries, a query once for every VECTORS vectors (of its cells); what leaves a
    block is k rows for each query. Vectors that are null have no score.
    """
    n, asked = vectors.count(), queries.count()
    qb, vb = max(1, -(-asked // block)), max(1, -(-n // min(VECTORS, max(1024, -(-n // LEAST)))))
    if cell:
        most = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        vb = max(1, -(-most // VECTORS))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    held = ["vec_id", "v", *(["codes"] if coded else [])]
    at = F.col("cell") if cell else F.lit(0)
    side = lambda df, asking, q, v: df.where("v is not null").select(at.cast("int").alias("cell"), q.alias("qb"), v.alias("vb"), F.lit(asking).alias("asked"), *held)
    rows = side(vectors, False, every(qb), own(vb)).unionByName(side(queries, True, own(qb), every(vb)))
    return rows.groupBy("cell", "qb", "vb").applyInArrow(_nearest(k, coded), _NEAR)


def _first(found: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query").orderBy(*order, "vec_id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, vec_id, score, position): cosine descending, id ascending. The query set is a stated one, met by blocks."""
    found = _by_blocks(vectors, queries, k, block).withColumn("score", F.round("score", 9))
    return _first(found, k, F.col("score").desc())


def quantise(vec: Column) -> Column:
    """Symmetric int8 codes and the scale: struct(scale, codes)."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(vec, lambda x: F.rint(x.cast("double") / scale).cast("tinyint")).alias("codes"))


def scan_int8(codes: Column, scale: Column, query: Column) -> Column:
    return scale * dot(codes, query)


def lsh(vectors: DataFrame, seed: int = 7, length: float = 0.5, tables: int = 8):
    """A random-projection index on unit vectors, where near by Euclid is near by cosine: (model, frame)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    frame = vectors.withColumn("features", array_to_vector("v"))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=tables, seed=seed).fit(frame), frame


def approx_top(index, frame: DataFrame, queries: DataFrame, k: int, radius: float, block: int = BLOCK) -> DataFrame:
    """(query, vec_id, d, position): top k among vectors that share a bucket with a query and lie within the radius.

    Buckets are compared in blocks: wide ones hold most pairs, which no row stands for.
    """
    from pyspark.ml.functions import vector_to_array

    hashed = index.transform(frame)
    tables = index.getNumHashTables()
    codes = F.array(*[vector_to_array(F.get("hashes", F.lit(i)))[0].cast("long") for i in range(tables)])
    coded = hashed.select("vec_id", "v", codes.alias("codes"))
    found = _by_blocks(coded, coded.join(queries.select("vec_id"), "vec_id", "left_semi"), k, block, coded=True)
    near = found.select("query", "vec_id", (-F.col("score")).alias("d")).where(F.col("d") < radius)
    return _first(near, k, F.col("d"))


def overlap(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k that the other list holds, over all queries."""
    e = exact.groupBy("query").agg(F.collect_set("vec_id").alias("e"))
    a = approx.groupBy("query").agg(F.collect_set("vec_id").alias("a"))
    return e.join(a, "query", "left").agg(F.avg(F.size(F.array_intersect("e", F.coalesce("a", F.array().cast("array<bigint>")))) / k).alias("overlap"))


#: Vectors that centres are fitted on: a sample by hash, so its size doesn't follow the table's.
FITTED = 20_000


def fit_centres(vectors: DataFrame, cells: int, rounds: int = 8, seed: int = 7, sample: int = FITTED) -> np.ndarray:
    """Centres of an inverted file by spherical k-means on at most `sample` unit vectors; with fewer vectors, fewer centres."""
    h = F.xxhash64(F.lit(seed), "vec_id")
    x = np.array([r[0] for r in vectors.orderBy(h, "vec_id").limit(sample).select("v").collect()])
    if not len(x):
        return np.zeros((0, 0))
    centres = x[:1]  # the farthest vector from the centres so far is the next one
    near = x @ centres[0]
    while len(centres) < min(cells, len(x)):
        centres = np.concatenate([centres, x[[near.argmin()]]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """vectors with `cell`, a row for each of the `probes` cells whose centres are nearest."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            cell = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(v)), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(cell.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, f"{fields}, cell int")


def ivf_top(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query, vec_id, score, position) among the vectors of the `probes` cells nearest to each query.

    index: `nearest_cells(vectors, centres, 1)`, every vector in its one cell. They meet by blocks of a cell.
    """
    asked = nearest_cells(queries.select("vec_id", "v"), centres, probes)
    found = _by_blocks(index, asked, k, BLOCK, cell=True).withColumn("score", F.round("score", 9))
    return _first(found, k, F.col("score").desc())


def compared_share(index: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """share: of all pairs of a query and a vector, how many the probes compare; from counts of cells."""
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = nearest_cells(queries.select("vec_id", "v"), centres, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    met = asked.join(sizes, "cell").agg(F.sum(F.col("asked") * F.col("n")).alias("pairs"))
    return met.join(queries.agg(F.count(F.lit(1)).alias("q"))).join(sizes.agg(F.sum("n").alias("rows"))).select((F.col("pairs") / (F.col("q") * F.col("rows"))).alias("share"))


def facet(items: DataFrame, brand: str | None = None, max_price: float | None = None) -> DataFrame:
    """Brand equality and a price limit; items without a price fail the limit."""
    out = items
    if brand is not None:
        out = out.where(F.col("brand") == brand)
    if max_price is not None:
        out = out.where(F.col("price") <= max_price)
    return out
