"""Connected components of an edge list, by alternating large and small stars.

Every round replaces edges by edges to the least neighbour. Minima are taken by aggregation,
which sums up before it shuffles, and are joined back, so that no list of a node's neighbours
is ever gathered. Each round is a stored table; the rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end; loops go."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, into: list[str] | None = None) -> DataFrame:
    """node, label (the least node of its component) of all nodes with an edge; edges: u, v.

    The path of the last round's table, which the result reads, is added to `into`."""
    spark, used = edges.sparkSession, []
    now, before = stored(_ordered(edges), "components", into=used), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        old, used = used, []
        now = stored(_ordered(_small_star(_ordered(_large_star(now)))), "components", into=used)
        discard(spark, old)
    if into is not None:
        into += used
    # now each node hangs on the least one of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
