"""Connected components of an edge table by alternating large-star and small-star steps.

Each step links nodes to the smallest node that they or their neighbours see, until nothing
changes; the number of steps grows with the logarithm of the longest path.  Only edges are moved,
each step's edges are written to the shared folder, and nothing is collected but a count and a
checksum.  Neighbours are never gathered: a step takes their minimum, which Spark combines before
it shuffles, and joins it back.  Both sides of that join come by an exchange, so Spark can split the
rows of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with ``m``: the least ``v`` of each ``u``, or ``u`` if that is less."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _least(down)
    moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(linked.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` to ``(node, component)``: each node that has an edge, and the smallest node it can reach."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, state(edges)
    while now != before and now[0]:
        for star in (_large_star, _small_star):
            edges = stored(star(edges).where("u <> v").distinct(), "edges")
        before, now = now, state(edges)
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
