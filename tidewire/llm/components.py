"""Connected components by alternating large-star and small-star rounds.

Each round hooks neighbours onto the smallest node that is seen from them, and is
written to the shared folder, so lineage stays short and nothing but two numbers
comes to the driver.  Minima are pre-aggregated before they are dealt out, and meet
the edges in a join on a key of its own, whose large partitions Spark can split: a
node with very many neighbours isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import written


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest v of u; the join key is ~u, so that both sides are dealt for the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("key"), "m")
    return edges.withColumn("key", F.bitwise_not("u")).join(least, "key").drop("key")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_minimum(both).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_minimum(down)
    return found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    unit: Column = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.sum(unit)).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link (columns u, v)."""
    edges = written(links.where("u <> v").select("u", "v").distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        edges = written(_small_star(_large_star(edges)), "stars")
        found = _state(edges)
        if found == seen:
            break
        seen = found
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
