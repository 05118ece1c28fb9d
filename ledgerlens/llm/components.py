"""Connected components by alternating large and small stars, one stored table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b.  Large: each node's greater neighbours link to the smallest of its
    neighbourhood.  Small: each node and its smaller neighbours do.  The hub of a large star is a hot
    join key, whose rows adaptive execution deals out to several tasks."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node reachable.

    Any order, repeats and loops (a = b) may occur; null ends are left out.  Rounds go on until none changes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_whole"))
    now = stored(pairs.filter("_whole and a <> b").select("a", "b").distinct(), "stars")
    mark = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (n, total)
        before, now = now, stored(_stars(_stars(now, True), False), "stars")
        dropped(before)
