"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Both steps are a minimum per node and a join, so a node with very many neighbours is pre-aggregated on the map side and
its join can be split; no neighbourhood is ever held by one task. Every round starts from stored files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component.

    Loops, repeated edges and either order of the ends are fine; an edge with a null end is no edge.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    while True:
        # Each edge from both ends. Stored, so that the join below has no aggregate beside it and a node with very many
        # neighbours can be split. A node is done if it hangs on one node alone and nothing hangs on it.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = stored(around.select("u", F.least("m", "u").alias("m"), "n"), "least")
        if least.where("m < u and n > 1").isEmpty():
            break
        # Large star: what is above a node hangs on the least node around it.
        least = least.select("u", "m")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        # Small star: a node and what is below it hang on the least node below it.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stored(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
