"""Connected components of links, without gathering a component anywhere.

Alternating large-star and small-star steps: a node's neighbours are hung onto the least of them,
until every node hangs directly onto the least of its component.  Minima are aggregated before
they are shuffled, and joins back onto a hub's links are ordinary joins that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import forget, persist_at


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link to another, the least node that links reach.

    Nulls, loops and repeated links do no harm; no links give no rows.  Written in the shared
    folder: lineage ends there.
    """
    spark = links.sparkSession
    first = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, path = persist_at(first, "links")
    while not _hung(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(own.select(F.col("hi").alias("w"), "m"), F.col("hi") == F.col("w")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after, path_after = persist_at(own.select("hi", F.col("m").alias("lo")).unionByName(hung).distinct(), "links")
        forget(spark, path)
        edges, path = after, path_after
    leaves = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaves.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _hung(edges: DataFrame) -> bool:
    """Whether every node hangs onto one other that hangs onto none."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
