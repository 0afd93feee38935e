"""Connected components of a link table, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


#: Links of a file of the tables between two steps: a small graph is not spread over as many files as a shuffle has partitions.
FILE_LINKS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that a link (columns a, b) has.

    Large-star and small-star steps in turn: each hands a node's neighbours to
    its smallest one, until every node hangs on its root.  Aggregations combine
    before the shuffle, and hubs are joined in a form that Spark can split.
    No links give no rows; a link of a node to itself is left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.stage(edges, "cc")
    before = None
    while (state := _state(edges)) != before:
        before = state
        files = 4 + state[0] // FILE_LINKS  # a step makes no more links than it was given, and one for each node
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.stage(large.coalesce(files), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = scratch.stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "cc")
        scratch.drop(large)
        scratch.drop(edges)
        edges = fresh
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
