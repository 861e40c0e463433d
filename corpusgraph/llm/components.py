"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, root (the smallest node it is linked with) for each node of links that isn't its own root.

    Every step aggregates a node's neighbours to their minimum before the shuffle, and edges only shrink towards
    stars; steps grow with the logarithm of the longest chain. Each step's edges are a table in the shared folder.
    """
    scratch = Scratch(links.sparkSession, "components")
    a, b = F.col(a), F.col(b)
    edges = scratch.save(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "0")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for step in range(most):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{step}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{step + 1}")
        scratch.free(f"{step}", f"{step}l")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not converge")
