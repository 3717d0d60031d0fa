"""Connected components of a graph given by links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_join, materialize


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has a link.

    Alternates large-star and small-star steps until every node points at its root, so the rounds
    grow with the logarithm of a component's diameter. Each round writes its links to the shared
    folder and deletes those of the round before. Minima are aggregated map-side; the links of hubs
    meet their minima by a broadcast (``hub_join``), so no node's links come into one task.
    Links of a node to itself and repeated links are ignored; no links give no rows.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _checksum(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n"))
        large = materialize(hub_join(both.where("v > u"), least, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = hub_join(large, below, "u", seen[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        for done in (last, least, large, below):
            discard(done)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
