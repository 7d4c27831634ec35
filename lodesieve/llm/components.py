"""Connected components of an edge table, by alternating large-star and small-star.

Each step is a group minimum, which is pre-aggregated before its shuffle, and one
join of the edges with those minima.  The edges of a node with very many neighbours
stay where they are and get its minimum by a broadcast (see ``skew``), so they are
never gathered in one place.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.skew import join_one
from lodesieve.sources.scratch import Scratch


def _minima(pairs: DataFrame) -> DataFrame:
    """For each u: the least of u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, scratch: Scratch, name: str, most: int) -> DataFrame:
    """Every node hands its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(_minima(both), f"{name}-least")
    return join_one(both, least, ["u"], most).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str, most: int) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.save(_minima(down), f"{name}-least")
    moved = join_one(down, least, ["u"], most).select(F.col("v").alias("w"), "m").unionByName(least.select(F.col("u").alias("w"), "m"))
    return moved.where("w <> m").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node, component`` for every node that has an edge; the component is its smallest node.

    ``edges`` has the long columns u and v.  Null ends, loops, repeats and either
    direction are allowed; without edges the result has no rows.
    """
    edges = edges.select("u", "v").where("u <> v")
    now = scratch.save(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-0")
    before = _digest(now)
    step = 0
    while before[0]:
        step += 1
        large = scratch.save(_large_star(now, scratch, f"{name}-{step}l", 2 * before[0]), f"{name}-{step}l")
        now = scratch.save(_small_star(large, scratch, f"{name}-{step}s", 2 * before[0]), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}l", f"{name}-{step}l-least", f"{name}-{step}s-least")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
