"""Connected components by alternating large-star and small-star steps, each step a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: every neighbour v of u, and the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``), the component named by its least node.

    A hub's neighbours are never gathered in one task: the least neighbour comes from a partial aggregation, and the
    join that hands it out can be split by Spark where one key is hot. Every round ends in a stored table.
    """
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        seen = _with_least(down)
        small = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).union(seen.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
