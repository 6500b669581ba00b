"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partially aggregated minimum and a join, so no task ever holds the
neighbours of a node; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
    return around.join(least, F.col("a") == F.col("at")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, with that least node.

    edges: columns a and b of any one orderable type, without nulls.
    """
    now = staged(_small_star(edges), "stars")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = staged(_small_star(_large_star(now)), "stars")
        before, state = state, _state(now)
    return now
