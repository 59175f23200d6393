"""Connected components by alternating stars, on edge tables of any size.

The large star links every larger neighbour of a node to the least node around it, the small star does so for smaller
neighbours; taken in turn they leave one star a component after a few rounds. A round is aggregates and equi-joins; its
edges are written to the shared folder, and only a count and a checksum reach the driver. The edges of a node with a large
share of all edges stay where they lie; the node's row is broadcast to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, share, written


def _least(edges: DataFrame) -> DataFrame:
    """The least v of each u, and the number of its edges; combined before the shuffle."""
    return written(edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "least")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("low", F.least("u", "low"))
    return joined(both.where("v > u"), least, "u", "n", share(edges, 2 * n)).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    edges = written(edges, "edges")
    least = _least(edges)
    moved = joined(edges, least, "u", "n", share(edges, n)).where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v of one orderable type. Returns node, root of every node with an edge to another; root is the least node of the component."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before, now = None, _mark(edges)
    while now[0] and now != before:
        edges = written(_small_star(_large_star(edges, now[0]), now[0]), "edges")
        before, now = now, _mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
