"""Iterative k-core pruning of a bipartite edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.scratch import written


def _degrees(edges: DataFrame, of: str) -> DataFrame:
    return edges.groupBy(of).agg(F.count(F.lit(1)).alias("n"))


def _kept(edges: DataFrame, degrees: dict[str, DataFrame], k: int) -> DataFrame:
    for of, n in degrees.items():
        edges = edges.join(n.where(F.col("n") >= k).select(of), of, "left_semi")
    return edges


def prune_once(edges: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Edges whose user and item both have k edges in this very snapshot."""
    return _kept(edges, {of: _degrees(edges, of) for of in (user, item)}, k).select(*edges.columns)


def kcore(edges: DataFrame, k: int, most: int = 50, user: str = "user_id", item: str = "item_id") -> tuple[DataFrame, list[dict]]:
    """The k-core and its funnel: rows, users and items of the input and after each pass.

    Each pass is written to the checkpoint folder, which cuts lineage and survives lost executors; so are its degrees, from
    which the funnel and the next pass follow. A pass that would drop nothing isn't run.
    """
    funnel: list[dict] = []
    columns = edges.columns
    for i in range(most + 1):
        edges = written(edges, "kcore")
        degrees = {of: written(_degrees(edges.where(F.col(of).isNotNull()), of), "degrees") for of in (user, item)}
        (n, users, low), (m, items, least) = [d.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.min("n")).first() for d in degrees.values()]
        rows = edges.count()
        funnel.append({"iteration": i, "rows": rows, "users": users, "items": items, "converged": bool(funnel) and rows == funnel[-1]["rows"]})
        if funnel[-1]["converged"]:
            return edges, funnel
        if i < most and rows == n == m and (not rows or min(low, least) >= k):
            return edges, [*funnel, {**funnel[-1], "iteration": i + 1, "converged": True}]
        edges = _kept(edges, degrees, k).select(*columns)
    raise RuntimeError(f"no {k}-core after {most} passes; funnel: {funnel}")
