"""The numbered operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sharding", "bpe_codec", "toxicity", "quality", "fingerprints", "packing", "html_text", "passages", "jaccard_join", "fuzzy_lines", "divergence", "super_kmers", "vector_codes"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"sievework.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"sievework.llm.{m}"), "ORACLE_SQL", {}).items()}
