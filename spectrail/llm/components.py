"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each vertex's neighbours, and the least of them and itself; only the least is gathered, so no task holds a vertex's neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return edges.join(least, edges.u == least.x).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of ``links`` (columns u, v, not null): the least vertex it is linked with, itself included.

    Links may repeat and point either way; links of a vertex to itself and an
    empty table are fine.  The rounds end when a round changes nothing.
    """
    loops = links.where("u = v").select("u").distinct()
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)  # every edge points to its smaller end
        edges = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if last is not None:
            dropped(last)  # edges no longer depend on the round before
        last = edges
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    heads = edges.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    found = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(heads)
    alone = loops.join(found, loops.u == found.vertex, "left_anti").select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    return found.unionByName(alone)
