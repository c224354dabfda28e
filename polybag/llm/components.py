"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.session import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return both.where("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    rest = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return least.select("u", F.col("least").alias("v")).union(rest).where("u != v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, in any direction, to (node, root): the least node of each component.

    Every round is written to the shared folder, so neither its plan nor a lost executor leads
    back to the start.  Nodes without an edge to another one are left out.
    """
    edges = saved(edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = saved(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct())
