"""Connected components of an edge table, by alternating large and small stars.

Every round is written to the shared folder; nothing but two numbers a round
reaches the driver.  Hot nodes are met by aggregates and joins only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = both.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "star") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the least node."""
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), f"{label}0")
    mark, k = None, 0
    while True:
        k += 1
        after = scratch.save(_star(_star(now, True), False), f"{label}{k}")
        new = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")), F.lit(0))).first())
        scratch.drop(f"{label}{k - 1}")
        now = after
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
