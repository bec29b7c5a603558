"""Connected components by alternating large-star and small-star steps.

Edges are (a, b) of any comparable type.  A large-star step links every larger neighbour of a node
to the least of its neighbourhood, a small-star step links the smaller ones and the node
itself; they alternate until the edges stay the same, which are then (node, least node of its
component).  A step is two joins on a node; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migscope.llm.text import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
    return near.join(least, near.a == least.u).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node here."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    rest = down.join(least, down.a == least.u).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not the least of its component, and that least node."""
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(now)
    while True:
        now = stored(small_star(large_star(now).where(F.col("a") != F.col("b")).distinct()).where(F.col("a") != F.col("b")).distinct(), "cc")
        after = _state(now)
        if after == state:
            return now
        state = after


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).collect()[0])
