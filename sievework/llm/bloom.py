"""A Bloom filter of longs that Spark builds. Its size follows the keys up to a fixed bound, so it may be broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB at most: with more keys it lets more through, which costs time only, as a join follows.
MOST_BITS, LEAST_BITS, PER_KEY = 27, 13, 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys.view(np.uint64))
    mask = np.uint64(2**bits - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(64 - MOST_BITS)) & mask).astype(np.int64)]


def first_column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy()


def bloom(rows: DataFrame, key: Callable[[pa.RecordBatch], np.ndarray] = first_column) -> np.ndarray:
    """The filter's words, for the longs that `key` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(key(batch), MOST_BITS)))
            word, first = np.unique(slots >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)), first) if len(slots) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = rows.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    # a filter of the full size folds to any smaller one
    size = int(np.clip(np.ceil(np.log2(PER_KEY * max(1, got.num_rows))), LEAST_BITS, MOST_BITS))
    out = np.zeros(2**size // 64, np.int64)
    np.bitwise_or.at(out, got["word"].to_numpy() & (len(out) - 1), got["bits"].to_numpy())
    return out


def known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for slot in _slots(keys, int(np.log2(len(bits) * 64))):
        hit &= (bits[slot >> 6] >> (slot & 63)) & 1 == 1
    return hit
