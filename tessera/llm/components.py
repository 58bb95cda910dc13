"""Connected components of an edge table, by alternating stars; nothing but the number of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal tables have equal marks."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any orderable type). Returns node, root for every node of an edge; root is the least node reached.

    Each round replaces edges so that nodes point to the least neighbour of their neighbours (large stars), then to their
    least neighbour (small stars). Neighbour lists are never gathered: only their minimum is, which is combined before the
    shuffle, and the join back on a node with very many edges can be split. Rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder, which cuts the lineage.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = _mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        then = written(hung.where("u <> v").distinct())
        mark = _mark(then)
        drop(now)
        now = then
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
