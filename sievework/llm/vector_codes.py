"""Operator 13: product codes of vectors by whole-number k-means, nearest entries found through segment means.

Components become floor(1024 x) and a vector four parts; each part position has a codebook of up to 256 entries, fixed in
size, that travels to all tasks. Four rounds assign all parts and move the entries to the floored means of their parts:
tasks add up their own parts first, Spark adds the tasks' sums (as decimals), and only the entries reach the driver.

The nearest entry is searched coarse to fine. Split a part and an entry into segments of b components: their squared
distance is at least the sum of b (difference of means)^2 + (difference of the residuals' norms)^2 over the segments. The
entry of least bound is measured exactly, entries with a bound above that go, and the rest meet the next, finer level.
What is left is measured exactly in whole numbers, ties to the lower index. Bounds are of floating point and filter with
a margin above their rounding error, so they never decide.

Rows whose vector is null or holds a null, infinite or NaN component are dropped. Rows of one vec_id are kept each, in the
order of their components; null ids come last. Labels that are null count as equal. With fewer than 256 vectors a
codebook has as many entries; with none the result is empty. Vectors must be alike in length, a multiple of four, and
components below 2^16 in size, else the job fails with a message. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import dropped, table, written

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Segments of a part, coarse to fine.
SEGMENTS = (1, 4)
#: Rows that a task measures at once; the largest component, so that squared distances of a part of some thousand components fit in 63 bits.
ROWS, LARGEST = 2000, 2**26


class _Level:
    """Sums and residual norms of the rows' segments."""

    def __init__(self, x: np.ndarray, segments: int):
        cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
        self.size = np.diff(cuts)
        self.sums = np.add.reduceat(x, cuts[:-1], axis=1)
        squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
        self.means = self.sums / self.size
        self.rest = np.sqrt(np.maximum(squares - self.means * self.sums, 0))

    def bound(self, rows: np.ndarray, other: _Level, entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for s, b in enumerate(self.size):
            out += b * (self.means[rows, s] - other.means[entries, s]) ** 2 + (self.rest[rows, s] - other.rest[entries, s]) ** 2
        return out


def _distances(x: np.ndarray, rows: np.ndarray, book: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x[rows] - book[entries]
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower index) and its squared distance, exactly, for each row."""
    n, k = len(x), len(book)
    rows, entries = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    best = np.full(n, np.iinfo(np.int64).max)
    # of the rounding errors: some units in the last place of the squared norms
    margin = 1 + 1e-9 * np.einsum("ij,ij->i", x.astype(float), x.astype(float)), 1e-9 * np.einsum("ij,ij->i", book.astype(float), book.astype(float))
    for segments in SEGMENTS:
        bound = _Level(x, segments).bound(rows, _Level(book, segments), entries)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.repeat(np.minimum.reduceat(bound, starts), np.diff(np.r_[starts, len(rows)]))
        first = np.flatnonzero(bound == least)
        first = first[np.r_[True, rows[first][1:] != rows[first][:-1]]]
        best = np.minimum(best, _distances(x, np.arange(n), book, entries[first]))
        left = bound <= best[rows] + margin[0][rows] + margin[1][entries]
        rows, entries = rows[left], entries[left]
    exact = _distances(x, rows, book, entries)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    least = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[starts, len(rows)])))
    hit = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
    return entries[hit], least


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): finite vectors as whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("embedding").isNotNull()).where(finite)
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) * SCALE < LARGEST)
    checked = F.when(small, F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"a component of a vector is {LARGEST // SCALE} or more in size")).cast("array<int>"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), checked.alias("v"))


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """(rows, parts, components of a part)."""
    flat = column.flatten().to_numpy().astype(np.int64)
    if len(flat) != len(column) * width or any(n != width for n in np.unique(np.diff(column.offsets.to_numpy()))):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), PARTS, width // PARTS)


def _sums(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, n, sums) of the parts that fall to each entry, one row for each task that has any."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                x = _parts(batch.column(0).slice(s, ROWS), width)
                for part in range(PARTS):
                    entry, _ = nearest(x[:, part], books[part])
                    np.add.at(n[part], entry, 1)
                    np.add.at(sums[part], entry, x[:, part])
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) of `whole_vectors`; the driver holds them and their sums only."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = len(first[0]["v"]) if first else 0
    if width % PARTS or (first and not width) or len({len(r["v"]) for r in first}) > 1:
        raise ValueError(f"vectors must be alike in length, a multiple of {PARTS}")
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // PARTS)]
        moved = _sums(vectors, books, width).groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)
        books = books.copy()
        for part, entry, n, *sums in moved.collect():  # at most one row for each entry
            books[part, entry] = [int(s) // n for s in sums]
    return books


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error)."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(books), PARTS * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                rows = batch.slice(s, ROWS)
                x = _parts(rows.column(2), width)
                found = [nearest(x[:, part], shared.value[part]) for part in range(PARTS)]
                code = np.stack([e for e, _ in found], 1).astype(np.uint8)
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' digest of each vector that is whole."""
    vectors = written(whole_vectors(rows), "vectors")
    books = fit(vectors)
    if not books.size:
        codes = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        codes = written(assign(vectors, books), "codes")
        dropped(vectors)
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13}


def _round_sql(r: int) -> str:
    """Assignment to the codebooks of round r and the codebooks after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{r} b ON p.part = b.part) GROUP BY 1, 2),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM a{r} a JOIN parts p ON p.row = a.row AND p.part = a.part) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry),"""


ORACLE_SQL = {
    "op13_vector_codes": f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row, * FROM whole),
parts AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM numbered, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, row AS entry, v FROM parts WHERE row < 256),{"".join(_round_sql(r) for r in range(ROUNDS))}
a{ROUNDS} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{ROUNDS} b ON p.part = b.part) GROUP BY 1, 2),
codes AS (SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM numbered JOIN codes USING (row) CROSS JOIN books"""
}
