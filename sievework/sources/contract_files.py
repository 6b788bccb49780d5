"""Contracts kept as JSON files, one for each table.

They are read strictly: a misspelt key, a check that could never act or two files for one table raise ValueError, as a
contract that silently checks less than it says is worse than none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sievework.operators.contracts import ROW_KINDS, TABLE_KINDS, Check, Contract

KEYS = {"table", "version", "columns", "checks"}
COLUMN_KEYS = {"name", "type", "nullable"}
OPTIONAL = {"range": {"low", "high", "below"}}


def _only(found: dict, allowed: set[str], needed: set[str], where: str) -> None:
    if not isinstance(found, dict) or set(found) - allowed or needed - set(found):
        keys = sorted(found) if isinstance(found, dict) else type(found).__name__
        raise ValueError(f"{where}: {keys} where {sorted(needed)} are needed and {sorted(allowed)} allowed")


def _unique(names: list[str], where: str) -> None:
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{where}: {twice} more than once")


def _check(raw: dict, where: str) -> Check:
    kind = raw.get("kind") if isinstance(raw, dict) else None
    if kind not in ROW_KINDS and kind not in TABLE_KINDS:
        raise ValueError(f"{where}: kind {kind!r}")
    params = set((ROW_KINDS | TABLE_KINDS)[kind])
    _only(raw, {"id", "kind", "action"} | params | OPTIONAL.get(kind, set()), {"id", "kind", "action"} | params, where)
    for name in {"columns", "values"} & set(raw):
        if not isinstance(raw[name], list) or not raw[name] or None in raw[name]:
            raise ValueError(f"{where}: {name} must be a list with values")
    for name in {"id", "column", "table", "ref_column"} & set(raw):
        if not isinstance(raw[name], str) or not raw[name]:
            raise ValueError(f"{where}: {name} must be a name")
    if raw["action"] == "quarantine" and kind in TABLE_KINDS:
        raise ValueError(f"{where}: {kind} is of the whole table and can quarantine no row")
    if raw.get("low") is not None and any(raw.get(k) is not None and raw["low"] > raw[k] for k in ("high", "below")):
        raise ValueError(f"{where}: a range that holds nothing")
    return Check(raw["id"], kind, raw["action"], {k: v for k, v in raw.items() if k not in ("id", "kind", "action") and v is not None})


def parse(text: str, origin: str = "contract") -> Contract:
    """The contract of one file."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{origin}: {e}") from e
    _only(raw, KEYS, {"table", "checks"}, origin)
    columns = raw.get("columns", [])
    for c in columns:
        _only(c, COLUMN_KEYS, {"name", "type"}, f"{origin}: columns")
    _unique([c["name"] for c in columns], f"{origin}: columns")
    checks = tuple(_check(c, f"{origin}: check {n}") for n, c in enumerate(raw["checks"]))
    _unique([c.id for c in checks], f"{origin}: checks")
    version = raw.get("version", 1)
    if not isinstance(version, int) or isinstance(version, bool) or version < 1:
        raise ValueError(f"{origin}: version {version!r}")
    return Contract(raw["table"], tuple((c["name"], c["type"], c.get("nullable", True)) for c in columns), checks, version)


def render(contract: Contract) -> str:
    """The file of a contract; parse(render(c)) equals c."""
    columns = [{"name": n, "type": t, "nullable": z} for n, t, z in contract.columns]
    checks = [{"id": c.id, "kind": c.kind, "action": c.action, **c.params} for c in contract.checks]
    return json.dumps({"table": contract.name, "version": contract.version, "columns": columns, "checks": checks})


def load(spark: SparkSession, path: str, pattern: str = "*.json") -> dict[str, Contract]:
    """All contracts of a folder by table, in the order of tables. Their files are configuration, a few kilobytes each."""
    files: DataFrame = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    found = [parse(r["value"], r["file"]) for r in files.selectExpr("value", "_metadata.file_name AS file").collect()]
    _unique([c.name for c in found], path)
    return {c.name: c for c in sorted(found, key=lambda c: c.name)}
