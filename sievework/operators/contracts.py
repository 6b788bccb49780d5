"""Contracts: columns and ordered checks that become one annotated plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import checks as C

ROW_KINDS = {"not_null": ("columns",), "allowed_values": ("column", "values"), "forbidden_values": ("column", "values"), "range": ("column",), "no_control_chars": ("columns",)}
TABLE_KINDS = {"no_all_null": ("columns",), "unknown_share": ("column", "value"), "foreign_key": ("column", "table", "ref_column")}
ACTIONS = ("quarantine", "fail", "measure")


@dataclass(frozen=True)
class Check:
    id: str
    kind: str
    action: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"{self.id}: action {self.action}")
        need = (ROW_KINDS | TABLE_KINDS).get(self.kind)
        if need is None or any(p not in self.params for p in need):
            raise ValueError(f"{self.id}: kind {self.kind} with {sorted(self.params)}")
        if self.kind == "range" and not {"low", "high", "below"} & set(self.params):
            raise ValueError(f"{self.id}: a range needs a limit")

    def violation(self) -> Column:
        p = self.params
        if self.kind == "range":
            return C.in_range(p["column"], p.get("low"), p.get("high"), p.get("below"))
        return getattr(C, self.kind)(*[p[k] for k in ROW_KINDS[self.kind]])


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[tuple[str, str, bool], ...]  # name, type, nullable
    checks: tuple[Check, ...]
    version: int = 1

    def gating(self) -> list[Check]:
        return [c for c in self.checks if c.action == "quarantine" and c.kind in ROW_KINDS]


def annotate(df: DataFrame, contract: Contract) -> DataFrame:
    """With the ids of violated checks, in their declared order."""
    checks = contract.gating()
    reasons = F.filter(F.array(*[F.when(c.violation(), F.lit(c.id)) for c in checks]), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return df.withColumn("violation_reasons", reasons)


def gate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with their reasons and the first of them."""
    marked = annotate(df, contract)
    bad = F.size("violation_reasons") > 0
    return marked.where(~bad).drop("violation_reasons"), marked.where(bad).withColumn("primary_reason", F.element_at("violation_reasons", 1))


def gate_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Total, quarantined and one count for each check, in one aggregation: check_id, rows."""
    marked = annotate(df, contract)
    counts = {"total": F.count(F.lit(1)), "quarantined": F.count_if(F.size("violation_reasons") > 0)}
    counts |= {f"gate__{c.id}": F.count_if(F.array_contains("violation_reasons", c.id)) for c in contract.gating()}
    return marked.agg(*[c.alias(k) for k, c in counts.items()]).unpivot([], list(counts), "check_id", "rows")


def conformance(df: DataFrame, contract: Contract) -> list[tuple[str, str]]:
    """pass, fail or measured for each declared column; a nullability that only the file lacks is measured."""
    own = {f.name: f for f in df.schema}
    out = []
    for name, kind, nullable in contract.columns:
        f = own.get(name)
        if f is None or f.dataType.simpleString() != kind.replace("long", "bigint"):
            out.append((f"schema__{name}", "fail"))
        else:
            out.append((f"schema__{name}", "pass" if nullable or not f.nullable else "measured"))
    return out


def audit(df: DataFrame, contract: Contract, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """check_id, status, violations and rows: all row checks in one aggregation, foreign keys by anti-join."""
    spark = df.sparkSession
    aggs, plan = {"__rows": F.count(F.lit(1))}, []
    for c in contract.checks:
        if c.kind in ROW_KINDS:
            aggs[c.id] = F.count_if(c.violation())
        elif c.kind == "no_all_null":
            aggs[c.id] = sum((F.when(F.count(x) == 0, 1).otherwise(0) for x in c.params["columns"]), F.lit(0))
        elif c.kind == "unknown_share":
            aggs[c.id] = F.count_if(F.col(c.params["column"]) == c.params["value"])
        else:
            ref = (tables or {})[c.params["table"]].select(F.col(c.params["ref_column"]).alias("__ref"))
            keys = df.where(F.col(c.params["column"]).isNotNull()).select(F.col(c.params["column"]).alias("__key"))
            orphans = keys.join(ref, F.col("__key") == F.col("__ref"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))
            plan.append(orphans.join(keys.agg(F.count(F.lit(1)).alias("rows"))).select(F.lit(c.id).alias("check_id"), F.lit(c.action).alias("action"), "violations", "rows"))
    wide = df.agg(*[a.cast("long").alias(k) for k, a in aggs.items()])
    names = [k for k in aggs if k != "__rows"]
    long_ = wide.unpivot(["__rows"], names, "check_id", "violations") if names else None
    actions = spark.createDataFrame([(c.id, c.action, c.kind) for c in contract.checks], "check_id string, action string, kind string")
    out = long_.join(F.broadcast(actions), "check_id").select("check_id", F.when(F.col("kind") == "unknown_share", "measure").otherwise(F.col("action")).alias("action"), "violations", F.col("__rows").alias("rows")) if names else None
    for p in plan:
        out = p if out is None else out.unionByName(p)
    status = F.when(F.col("action") == "measure", "measured").when((F.col("violations") == 0) | (F.col("rows") == 0), "pass").otherwise("fail")
    return out.select("check_id", status.alias("status"), "violations", "rows")


def reason_counts(quarantined: DataFrame, primary: bool) -> DataFrame:
    reason = F.col("primary_reason") if primary else F.explode("violation_reasons")
    return quarantined.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def conserve(total: int, kept: int, quarantined: int, exact: int, superseded: int) -> None:
    if total != kept + quarantined + exact + superseded:
        raise AssertionError(f"{total} rows in, {kept} + {quarantined} + {exact} + {superseded} accounted for")
