"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation and a join, both of which split hot nodes: a hub
with a third of all edges costs one partial minimum per task, and its join is
split by adaptive execution. Each step is written to the shared folder, so a
lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.session import materialize


def _with_least(directed: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least node of u's neighbourhood, u itself included."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _distinct(_with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionByName(met.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its least node.

    Self-loops make a component of one. Null ends are ignored, repeated edges
    count once, an empty table gives an empty result.
    """
    edges = materialize(edges.where("u is not null and v is not null").select("u", "v").distinct(), label)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars, state = materialize(_distinct(edges), label), None
    while (now := _state(stars)) != state and now[0]:
        state = now
        stars = materialize(_small_star(materialize(_large_star(stars), label)), label)
    # At the fixed point every node but the least of its component has one edge, to that least node.
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select(
        "node", F.coalesce("least", "node").alias("component"))
