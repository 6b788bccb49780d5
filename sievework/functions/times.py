"""Temporal splits, windows and buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Splits:
    """Train and validation end inclusively, test exclusively."""

    train_end: str
    val_end: str
    test_end: str

    def label(self, ts: Column) -> Column:
        at = lambda s: F.lit(s).cast("timestamp_ntz")
        return F.when(ts <= at(self.train_end), "train").when(ts <= at(self.val_end), "val").when(ts < at(self.test_end), "test")

    def stage(self, ts: Column) -> Column:
        """A number that grows with time: 1 to 3 are the labels, 4 is later, 0 is no time."""
        label = self.label(ts)
        number = F.when(label == "train", 1).when(label == "val", 2).when(label == "test", 3).when(self.out_of_range(ts), 4)
        return F.coalesce(number, F.lit(0)).cast("byte")

    def out_of_range(self, ts: Column) -> Column:
        return F.coalesce(ts >= F.lit(self.test_end).cast("timestamp_ntz"), F.lit(False))


MAIN = Splits("1999-12-31", "2000-06-30", "2002-01-01")
SPARSE = Splits("1995-06-30", "2000-06-30", "2002-01-01")

SEGMENT_EDGES = (0, 4, 9, 19)
SEGMENTS = ("0", "1-4", "5-9", "10-19", "20+")
DEEP_EDGES = (0, 4, 9, 19, 49, 99)
DEEP = ("0", "1-4", "5-9", "10-19", "20-49", "50-99", "100+")


def bucket(n: Column, edges: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """The first bucket whose upper edge is not below n, else the last."""
    out = F.when(n <= edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:-1], strict=True):
        out = out.when(n <= edge, name)
    return out.otherwise(names[-1])


def support_bucket(n: Column) -> Column:
    return F.when(n == 0, "zero").when(n <= 4, "low").otherwise("ok")


RECENCY = ("<=90d", "91-365d", ">365d", "never")


def recency_bucket(last: Column, as_of: str) -> Column:
    """How long before as_of the last training interaction was; items without one are `never`."""
    days = age_days(last, as_of)
    return F.when(last.isNull(), RECENCY[3]).when(days <= 90, RECENCY[0]).when(days <= 365, RECENCY[1]).otherwise(RECENCY[2])


def first_seen_bucket(first: Column, train_end: str, oldest: int) -> Column:
    """The year (UTC) of the first interaction up to train_end, years up to `oldest` together; later ones are post-cutoff."""
    year = F.year(first)
    after = first.isNull() | (first > F.lit(train_end).cast("timestamp_ntz"))
    return F.when(after, "post-cutoff").when(year <= oldest, F.lit(f"<={oldest}")).otherwise(year.cast("string"))


def age_days(ts: Column, as_of: str) -> Column:
    """Fractional days from ts to as_of."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.lit(as_of)) - micros(ts)) / F.lit(86_400_000_000.0)


def from_epoch(c: Column, unit: str) -> Column:
    """A timestamp from whole milliseconds or seconds since 1970 (UTC)."""
    if unit not in ("milliseconds", "seconds"):
        raise ValueError(f"unit {unit}")
    return F.timestamp_millis(c) if unit == "milliseconds" else F.timestamp_seconds(c)


def in_window(ts: Column, as_of: Column, days: Column) -> Column:
    """ts <= as_of, and after as_of - days unless days is 0; the lower edge is open."""
    return (ts <= as_of) & ((days == 0) | (ts > as_of - F.make_dt_interval(days)))


def half_open(ts: Column, start: str, end: str) -> Column:
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def hash_share(columns: list[str], parts: int, least: int) -> Column:
    """A deterministic share of rows: the hash of the columns falls below `least` of `parts`."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)) < least


def late_update(columns: list[str], ts: Column, start: str, end: str, parts: int, held: int, updated: int) -> Column:
    """Landed rows of the late window that are replayed as updates: not held out, and in the share `updated` of a second
    hash, whose first two columns change places so that the two draws are independent."""
    late = half_open(ts, start, end)
    swapped = [columns[1], columns[0], *columns[2:]]
    return late & ~hash_share(columns, parts, held) & hash_share(swapped, parts, updated)
