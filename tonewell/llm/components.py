"""Connected components of an edge table by alternating large and small stars.

Each round groups edges by node and keeps only a minimum per node, combined before the shuffle, so a node
with any number of neighbours is no burden. Lineage is cut with checkpoint() after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # edges have a < b: the neighbours of b that are not larger
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b").select("m", F.col("a").alias("x")).where("m <> x")
    return linked.unionByName(least.select("m", F.col("b").alias("x"))).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component: for every node of an edge, the smallest id it is connected with.

    `edges` has a and b (BIGINT); order, repetitions and loops do not matter, a node with loops only is left out.
    """
    now = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = _state(now)
    while state[0]:
        now = checkpoint(_small(_large(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    # in the end every edge leads from the smallest id of its component
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
