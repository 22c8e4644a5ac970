"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, freed


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One step: hang neighbours on the smallest of a node and its neighbours.

    The minimum is a partial aggregate and the join back may be split by the optimizer, so a hub with
    a large share of the edges does not gather in one task.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.filter("u != m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); label is the smallest node reachable.

    Loops and repeated edges are harmless; an empty table gives an empty one. Each round is a
    checkpoint, so a lost executor costs one round at most.
    """
    cols = [F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")]
    now = cut(edges.select(*cols).filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        bigger = _star(both, large=True).filter("u != v").distinct()
        small = bigger.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut(_star(small, large=False).filter("u != v").distinct())
        seen = freed(now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
                             F.count_if(F.col("u") < F.col("v")).alias("up"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Root of each of ``n`` local nodes under the links a-b (the smallest index reachable)."""
    root = np.arange(n) if parent is None else parent
    while True:
        low = np.minimum(root[a], root[b])
        high = np.maximum(root[a], root[b])
        if np.array_equal(low, high):
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
