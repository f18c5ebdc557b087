"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm import runtime


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node but the roots, of the edges in one task."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    up = root != np.arange(len(ids))
    return ids[up], ids[root[up]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest.

    Each round keeps at most one edge for each node and direction, so the table
    never grows; it is written to the shared folder between rounds.  Minima are
    taken by grouping (partial aggregates), not by windows, so a hub's edges
    need not meet in one task.  Nodes may be of any type that has an order.
    Rounds grow with the logarithm of the longest path; more than
    ``max_rounds`` raise an error and give no half-finished result.
    """
    spark = edges.sparkSession
    cur, path = runtime.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is hung below the smallest of u's neighbourhood
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, are hung below the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt, nxt_path = runtime.written(small)
        state = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        runtime.delete(spark, path)
        cur, path = nxt, nxt_path
        if tuple(state) == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError("components did not settle")
