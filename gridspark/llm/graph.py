"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): for each vertex of edges (a, b), the least vertex that it reaches; vertices are of any type with an order.

    In each round a vertex hooks to its least neighbour if that is smaller, follows hooks four steps, and the graph is contracted to
    the vertices where they arrive, so at least half of the vertices of a component are gone after as many rounds as its hooks are
    deep; long chains are halved, too. Each round ends in a written table. Labels of the rounds are then followed one after the
    other. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")

    def of_both_ways(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(a != b)
        return written(pairs.unionByName(pairs.select(b.alias("a"), a.alias("b"))).distinct())

    def twice(up: DataFrame) -> DataFrame:
        return up.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))

    left, maps = of_both_ways(edges.select("a", "b")), []
    while not maps or not left.isEmpty():
        label = written(twice(twice(left.groupBy(a.alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")))))
        ends = label.select(F.col("v").alias("a"), F.col("p").alias("x")), label.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = left.filter(a < b).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # Where four steps don't arrive at the end of the hooks, the way on is an edge.
        further = label.select(F.col("p").alias("a")).distinct().join(ends[0], "a").select("a", F.col("x").alias("b"))
        after = of_both_ways(moved.unionByName(further))
        forget(left)
        left = after
        maps.append(label)
    forget(left)
    step = lambda got, more: got.join(more.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return reduce(step, maps).withColumnRenamed("p", "comp")
