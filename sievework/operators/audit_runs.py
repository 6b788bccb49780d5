"""Runs of all contracts over their tables, kept in a ledger, and which of them are whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.contracts import Contract, audit, conformance
from sievework.sources import ledger

SCHEMA = "table_name string, version long, check_id string, kind string, status string, violations long, rows long"


@dataclass(frozen=True)
class Outcome:
    """code: 0 when no check fails, 1 when one does, 2 when the run could not begin (`problem`; nothing is written)."""

    run_id: str
    code: int
    statuses: dict[str, int] = field(default_factory=dict)
    skipped: tuple[str, ...] = ()
    problem: str = ""


def audited(spark: SparkSession, name: str, df: DataFrame, contract: Contract, refs: dict[str, DataFrame]) -> DataFrame:
    """One row for each declared column (kind schema; it reads no rows, so `rows` is null) and for each check."""
    kinds = spark.createDataFrame([(c.id, c.kind) for c in contract.checks], "check_id string, kind string")
    own = [(name, contract.version, i, "schema", s, int(s == "fail"), None) for i, s in conformance(df, contract)]
    head = spark.createDataFrame(own, SCHEMA)
    if not contract.checks:
        return head
    found = audit(df, contract, refs).join(F.broadcast(kinds), "check_id")
    return head.unionByName(found.select(F.lit(name).alias("table_name"), F.lit(contract.version).cast("long").alias("version"), "check_id", "kind", "status", "violations", "rows"))


def _missing(df: DataFrame, contract: Contract) -> list[str]:
    named = {x for c in contract.checks for x in [*c.params.get("columns", []), *([c.params["column"]] if "column" in c.params else [])]}
    return sorted(named - set(df.columns))


def run(spark: SparkSession, contracts: dict[str, Contract], read: Callable[[str], DataFrame | None], path: str, run_id: str, at: datetime | None = None, skip_missing: bool = False) -> Outcome:
    """Audits the table of each contract and appends the rows, stamped with run_ts, to the ledger at `path`.

    `read` gives a table by name, or None where there is none: then the run ends with code 2, or the table is left out
    with `skip_missing`. A run that is repeated replaces its own rows. Each table is scanned once and foreign keys are
    anti-joins; all tables' audits are one job.
    """
    out, skipped = [], []
    for name, contract in contracts.items():
        df = read(name)
        if df is None:
            if not skip_missing:
                return Outcome(run_id, 2, problem=f"{name}: no such table")
            skipped.append(name)
            continue
        if gone := _missing(df, contract):
            return Outcome(run_id, 2, problem=f"{name}: no columns {gone}")
        refs = {c.params["table"]: read(c.params["table"]) for c in contract.checks if c.kind == "foreign_key"}
        if absent := sorted(t for t, ref in refs.items() if ref is None):
            return Outcome(run_id, 2, problem=f"{name}: no tables {absent} to refer to")
        out.append(audited(spark, name, df, contract, refs))
    if not out:
        return Outcome(run_id, 2, skipped=tuple(skipped), problem="no table to audit")
    stamp = F.lit((at or datetime.now(UTC)).isoformat()).cast("timestamp")
    ledger.append(reduce(DataFrame.unionByName, out).withColumn("run_ts", stamp), path, run_id, 0)
    mine = ledger.read(spark, path).where(F.col("run_id") == run_id).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    statuses = {r["status"]: r["n"] for r in mine.collect()}
    return Outcome(run_id, int(statuses.get("fail", 0) > 0), statuses, tuple(skipped))


def coverage(rows: DataFrame, required: list[str]) -> DataFrame:
    """For each run of a ledger: run_id, run_ts (its first), missing (required tables without a row, sorted), repeated
    (checks of a table with several rows) and complete (neither)."""
    per = rows.groupBy("run_id", "table_name", "check_id").agg(F.count(F.lit(1)).alias("n"), F.min("run_ts").alias("run_ts"))
    want = F.array(*[F.lit(t) for t in sorted(set(required))]).cast("array<string>")
    runs = per.groupBy("run_id").agg(F.min("run_ts").alias("run_ts"), F.array_sort(F.array_except(want, F.collect_set("table_name"))).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))
    return runs.withColumn("complete", (F.size("missing") == 0) & (F.col("repeated") == 0))


def latest_complete(rows: DataFrame, required: list[str], pinned: str | None = None) -> DataFrame:
    """The rows of the latest complete run (by run_ts, then run_id), or of `pinned` if that one is complete; else none."""
    good = coverage(rows, required).where("complete")
    if pinned is not None:
        good = good.where(F.col("run_id") == pinned)
    best = good.agg(F.max(F.struct("run_ts", "run_id")).alias("b")).select(F.col("b.run_id").alias("run_id"))
    return rows.join(F.broadcast(best), "run_id", "left_semi")
