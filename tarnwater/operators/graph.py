"""Connected components by alternating star contraction (Kiveris et al., 2014), each round written to the shared folder.

A round's work is proportional to the edges left. The minimum of each node's neighbours is pre-aggregated before the shuffle and
joined back, so that a node with very many neighbours is never gathered in one task, and Spark may split its part of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.where("b > a").join(least, "a").select(F.least("a", "m").alias("a"), "b").where("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b long): the smallest node that its links reach.

    Loops, repeated and reversed edges are allowed; a null end is no edge. No edges, no rows.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole")).where("whole and a < b").drop("whole").distinct(), "edges")
    was, is_ = None, _state(now)
    while is_ != was and is_[0]:
        after = stored(_small_star(_large_star(now)), "edges")
        was, is_ = is_, _state(after)
        dropped(spark, now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
