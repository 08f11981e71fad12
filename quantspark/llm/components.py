"""Connected components of a large edge list by alternating large-star and small-star steps.

Every step keeps the components and points nodes at smaller neighbours until each edge joins a node to the
smallest node of its component; the number of rounds grows with the logarithm of the size. A round
groups by node with partial minima, so a hub with many neighbours is one small row before the shuffle, and
the joins back are plain equi-joins that adaptive execution may split. The edges are staged after each
round, so lost executors re-read a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.rows import stage


def _star(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v): with each u the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): node -> root, the smallest node of its component. Only nodes with an edge; roots too."""
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.selectExpr("inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))")
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stage(small.select("e.*").filter("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
