"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as (u, v) and as (v, u), in one reading."""
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of these. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether the larger node of every edge is in no other edge; edges: u > v, distinct."""
    up = F.col("u") > F.col("v")
    per = _both_ways(edges).groupBy("u").agg(F.count(F.when(up, 1)).alias("ups"), F.count("*").alias("n"))
    return per.agg(F.count(F.when((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("n") > 1)), 1))).first()[0] == 0


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (the least node that it reaches), for every node of edges (u, v); self-links are ignored.

    Each round writes its edges to the shared folder; none is needed where the edges are stars already. An empty table gives an empty result.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        if _stars(now):
            break
        now = stored(_small_star(stored(_large_star(now).distinct(), "cc")).distinct(), "cc")
    else:
        raise RuntimeError("components did not converge")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
