"""Connected components of an edge table by alternating large-star and
small-star steps.  Each step is a minimum per node and a join; edges are
written to the shared folder between rounds, so lineage stays short, and
neither edges nor components are collected.

Defined cases: an edge from a node to itself, or with a null end, says nothing
(a node with no other edge is in no component); repeated edges and edges in
both directions count once; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lcspark.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of node and neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    smaller = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.union(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written and read again, and their number and hash sum as
    observed by the write."""
    seen = Observation()
    out = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")),
                 "stars")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge; ``edges`` has a and b (bigint,
    a <> b), root is the component's least node.  An empty table gives none."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    stars, state = _stored(ordered)
    while state[0]:
        before = state
        stars, state = _stored(_small_star(_large_star(stars)))
        if state == before:
            break
    pairs = stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
