"""Connected components by alternating large and small stars, as shuffles of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours (larger ones, or smaller ones and the node itself) to the smallest neighbour."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges  # a > b always
    around = materialize(around, "star")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = join_hot(around, least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node it reaches. Any number of links, in any order."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "edges")
    mark = None
    while True:
        edges = materialize(_star(materialize(_star(edges, True), "edges"), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
