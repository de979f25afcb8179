"""Connected components of links, by alternating large and small stars, each round kept in a shared table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each entry the least member of its set, fully compressed) after joining a[i] with b[i]."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable. Rows are hash-partitioned
    by node throughout; a node with many links is a skewed join side, which adaptive execution splits."""
    edges = write_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        former, edges = edges, write_shared(small.unionByName(root.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        drop_shared(former)
        old, mark = mark, _mark(edges)
        if mark == old:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(stars.select("node"), "node", "left_anti"))
