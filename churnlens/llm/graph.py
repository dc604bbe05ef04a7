"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Large-star and small-star rounds: every node hands its smallest neighbour to its
    larger, then to its smaller neighbours, until all edges point at a root; the number
    of rounds grows with the logarithm of the nodes.  A round aggregates before it joins, and
    what it has aggregated is written out: Spark splits a join at a node with many edges only
    where the join does not stand right above its aggregate.  Edges are checkpointed."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .distinct().checkpoint())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")).checkpoint()
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = large.checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        e = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint())
