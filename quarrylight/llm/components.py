"""Connected components of an edge table by repeated contraction.

Each round every node points to the neighbour (or itself) of least priority, the pointers are followed
twice, and edges move to where their ends point.  Priorities are drawn anew each round, so the number of
nodes left falls by a constant share.  Minima are pre-aggregated; joins are plain equi-joins, which Spark
splits where a node holds many edges.  Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.runtime import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the (a, b) edges; nodes of one component, and no others, share a root."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(c, F.lit(turn))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("to"))).alias("m"))
        # of the node and its best neighbour, the one of less priority
        points = best.select(F.col("a").alias("node"), F.when(order("a") <= F.col("m.o"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        points = written(points, "points")
        again = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
        points = written(points.join(again, "to").select("node", F.col("then").alias("to")), "points")
        if roots is None:
            roots = points.select("node", F.col("to").alias("root"))
        else:
            moved = points.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        a = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of n places' components under some links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            break
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    while (root[root] != root).any():
        root = root[root]
    return root
