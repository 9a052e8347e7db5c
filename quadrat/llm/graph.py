"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """node and root (the smallest node that it reaches) for each end of edges (a, b: long, a < b).

    Each round, every node points to its smallest neighbour, pointers are followed to their ends, by
    doubling, and the edges are drawn anew between the ends. An end that no node points to has, after a
    round, a smaller neighbour and is gone after the next: every two rounds at least halve the nodes
    that still have edges. The driver sees counts alone.
    """
    left = scratch.table(edges.select("a", "b").distinct(), f"{label}-edges0")
    roots, k = None, 0
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), f"{label}-up{k}")
        jump, moved = 0, True
        while moved:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jumped = scratch.table(up.join(over, "up").select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")), f"{label}-up{k}-{jump}")
            moved = jumped.filter("moved").limit(1).count() > 0
            up, jump = jumped.select("node", "up"), jump + 1
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        drawn = left.join(a, "a").join(b, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = scratch.table(drawn, f"{label}-edges{k + 1}")
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "up")
            roots = scratch.table(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{label}-roots{k}")
        k += 1
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return roots
