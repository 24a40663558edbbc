"""Connected components of a graph that no machine can hold.

Large-star and small-star steps (Kiveris and others, "Connected components in
MapReduce and beyond", 2014): every step relinks neighbours to the smallest
vertex in sight, until each vertex points at the smallest one it can reach.
Minima are combined before the shuffle and written down, so that the join on a
vertex with very many links meets two plain exchanges, which adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.session import settle


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every vertex of ``links(a, b)``; root is the smallest vertex reachable.

    ``a`` and ``b`` may be of any type that has an order.  A link of a vertex
    to itself, a repeated link and the direction of a link mean nothing; links
    with NULL are left out; no links give no rows.
    """
    edges = settle(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = _signature(edges)
    while seen[0]:
        edges = settle(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    """Two numbers that stay the same once nothing changes."""
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    smallest = settle(
        edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        .unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        .groupBy("x")
        .agg(F.min("y").alias("m"))
        .select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
    )
    return edges.join(smallest, "v").select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    smallest = settle(edges.groupBy("u").agg(F.min("v").alias("m")))
    others = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
