"""Connected components by alternating large-star and small-star steps.

A vertex with more than a HOT-th of all edge ends is joined by broadcast, and its edges are dealt by
both ends, so they never meet in one task; fewer than HOT vertices can have so many.

The least neighbours of a half round and the edges it gives are written one after the other. So no
plan holds another one twice, and what the driver keeps of a round (plans, stages, tasks) is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

HOT = 1000
FEW = 100  # edge ends of a vertex that any task can take


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the least v of each u of pairs (u, v), and its number of pairs."""
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def _with_least(pairs: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """pairs (u, v) with m of their u. ends: rows of pairs."""
    hot = F.col("n") > max(FEW, ends // HOT)
    crowded = F.broadcast(least.filter(hot).select("u", F.col("m").alias("hot_m")))
    dealt = pairs.join(crowded, "u", "left").withColumn("at", F.when(F.col("hot_m").isNull(), F.xxhash64("u")).otherwise(F.xxhash64("u", "v")))
    rest = least.filter(~hot).select("u", F.xxhash64("u").alias("at"), "m")
    return dealt.join(rest, ["u", "at"], "left").select("u", "v", F.coalesce("hot_m", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from either end."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """One large-star then one small-star, written; edges (u, v) have u > v and come out the same way, each once."""
    large = _with_least(_both(edges), least, ends).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    large = stage(large, "large")
    lower = _least(large)
    small = _with_least(large, lower, ends // 2).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    out = stage(small.distinct(), "edges")
    for used in (large, lower):
        unstage(used)
    return out


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of every id that has a link; component_id is the least id reachable.

    Rounds end when each vertex that has a smaller neighbour has no other one: every component is
    then a star around its least id. A vertex for which this does not hold has an edge whose end the
    round lowers, so rounds end by themselves. Nothing but two numbers a round reaches the driver.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        least = _least(_both(edges))
        ends, left = least.agg(F.sum("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not left:
            unstage(least)
            break
        new = _star(edges, least, ends)
        for used in (edges, least):
            unstage(used)
        edges = new
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id"))
    )
