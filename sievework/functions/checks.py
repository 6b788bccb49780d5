"""Violations of contract checks as Columns that are never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import CONTROL, any_of


def not_null(columns: list[str]) -> Column:
    return any_of([F.col(c).isNull() for c in columns])


def allowed_values(column: str, values: list) -> Column:
    """Null is a violation."""
    return F.coalesce(~F.col(column).isin(values), F.lit(True))


def forbidden_values(column: str, values: list) -> Column:
    """Null passes."""
    return F.coalesce(F.col(column).isin(values), F.lit(False))


def in_range(column: str, low=None, high=None, below=None) -> Column:
    """Outside [low, high] or not under `below`; null passes."""
    c, out = F.col(column), F.lit(False)
    for limit, bad in ((low, lambda v: c < v), (high, lambda v: c > v), (below, lambda v: c >= v)):
        if limit is not None:
            out = out | bad(F.lit(limit))
    return F.coalesce(out, F.lit(False))


def no_control_chars(columns: list[str]) -> Column:
    return F.coalesce(any_of([F.coalesce(F.col(c).rlike(CONTROL), F.lit(False)) for c in columns]), F.lit(False))
