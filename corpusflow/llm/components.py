"""Connected components by alternating stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones) move to the least of them."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum: equal only for the same set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` of the nodes of ``edges(u, v)``; a component's name is its
    least node. Every round is written to the shared folder; rounds grow with the
    logarithm of the longest chain, and no list of nodes reaches the driver."""
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), name)
    last, same = None, _mark(edges)
    while same != last:
        edges = materialize(_star(_star(edges, True), False), name)
        last, same = same, _mark(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))
