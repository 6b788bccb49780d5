"""Runs that may be compared: their inputs must be of one version, or of versions proved and attested to be alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import canonical


class LineageError(RuntimeError):
    pass


@dataclass(frozen=True)
class Scored:
    """An arm's run and the version of the table that it was scored on."""

    arm: str
    run_id: str
    version: int


@dataclass(frozen=True)
class Attested:
    """One arm's run on `recorded` may stand beside runs on `current`, if both versions hold the same rows."""

    arm: str
    run_id: str
    recorded: int
    current: int
    reason: str


def digests(df: DataFrame, by: list[str]) -> DataFrame:
    """by, rows and two digests that don't depend on order or files: a sum and an exclusive or of other row hashes.

    Columns are taken by name, so their order doesn't count; null differs from the empty text; equal rows count as often
    as they stand. One aggregation with partial sums before its shuffle, so a month with a third of all rows is no
    more than a row for each task.
    """
    fields = sorted(df.schema, key=lambda f: f.name)
    values = [canonical(f"`{f.name}`", f.dataType.simpleString()) for f in fields]
    nulls = F.concat(F.lit(""), *[F.col(f"`{f.name}`").isNull().cast("int").cast("string") for f in fields])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.coalesce(F.sum(F.xxhash64(nulls, *values).cast("decimal(38,0)")), F.lit(0)).alias("__sum"),
        F.coalesce(F.bit_xor(F.xxhash64(*reversed(values), nulls)), F.lit(0)).alias("__xor"),
    )


def unequal(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose rows differ between two tables: by, rows_a, rows_b (0 where a side has none). Null groups meet.

    Columns that only one table has make all groups differ that have a row.
    """
    x, y = (digests(d, by).select(F.struct(*by).alias(f"__{s}"), F.struct("__rows", "__sum", "__xor").alias(f"__d{s}")) for d, s in ((a, "x"), (b, "y")))
    both = x.join(y, F.col("__x").eqNullSafe(F.col("__y")), "full_outer")
    if sorted(a.columns) == sorted(b.columns):
        both = both.where(~F.col("__dx").eqNullSafe(F.col("__dy")))
    rows = [F.coalesce(F.col(f"__d{s}.__rows"), F.lit(0)).alias(f"rows_{n}") for s, n in (("x", "a"), ("y", "b"))]
    return both.select(F.coalesce("__x", "__y").alias("__by"), *rows).select("__by.*", "rows_a", "rows_b")


def admit(scored: list[Scored], current: int, read: Callable[[int], DataFrame], by: list[str], attested: Attested | None = None) -> dict:
    """Raises LineageError unless all arms may be compared on version `current` of a table; returns what to disclose.

    Without an exception every arm must have been scored on `current`. An exception covers one run of one arm: it must
    name versions as they are, another arm's mismatch isn't covered, one that nothing needs is an error, and both
    versions are read and must hold the same rows by group. Nothing is read where no exception is declared.
    """
    if len({s.arm for s in scored}) != len(scored):
        raise LineageError("an arm is scored twice")
    off = [s for s in scored if s.version != current]
    said = "; ".join(f"{s.arm} ({s.run_id}) on {s.version}" for s in off)
    if attested is None:
        if off:
            raise LineageError(f"not scored on version {current}: {said}")
        return {"exception_used": False}
    if attested.current != current:
        raise LineageError(f"the exception is for version {attested.current}, not {current}")
    mine = [s for s in scored if (s.arm, s.run_id) == (attested.arm, attested.run_id)]
    if not mine:
        raise LineageError(f"the exception is for {attested.arm} ({attested.run_id}), which isn't scored here")
    others = [s for s in off if s.arm != attested.arm]
    if others:
        raise LineageError(f"the exception doesn't cover {'; '.join(f'{s.arm} ({s.run_id}) on {s.version}' for s in others)}")
    if not off:
        raise LineageError(f"the exception for {attested.arm} isn't needed and must be taken out")
    if mine[0].version != attested.recorded:
        raise LineageError(f"{attested.arm} was scored on {mine[0].version}, not on {attested.recorded} as the exception says")
    groups, gone = unequal(read(attested.recorded), read(current), by).agg(F.count(F.lit(1)), F.min(F.to_json(F.struct(*by)))).first()
    if groups:
        raise LineageError(f"versions {attested.recorded} and {current} differ in {groups} groups, the first of them {gone}")
    return {"exception_used": True, "arm": attested.arm, "run_id": attested.run_id, "recorded": attested.recorded, "current": current, "reason": attested.reason}
