"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """The least node of each node's component, from links ``u``, ``v`` between numbers.

    Returns ``node``, ``root`` for every linked node.  Each round hangs the larger
    neighbours of every node on its least neighbour, then the smaller ones.  Rounds grow with
    the logarithm of a component's width.  The minima are written tables, so the
    joins on hubs stay plain shuffled joins whose hot partitions Spark splits.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = workspace.write(e, "edges")
    mark, turn = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = workspace.write(least, f"large-least-{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = workspace.write(large, f"large-{turn}")
        least = workspace.write(large.groupBy("u").agg(F.min("v").alias("m")), f"small-least-{turn}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = workspace.write(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"small-{turn}")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            break
        mark, turn = now, turn + 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
