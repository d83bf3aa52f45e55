"""Connected components by alternating large and small stars (Kiveris et al., SoCC 2014).

Every round replaces links by links to smaller neighbours and is written out; nothing
but a count and a checksum of the links comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.staging import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours on one side of it, linked to its smallest neighbour instead."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sided = both if large else links  # links run from the larger end a to the smaller b
    least = sided.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = sided.join(least, "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link in (a, b); a component is named after
    its smallest node. Self-links and repeats are allowed."""
    ordered = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now, seen = stage(ordered, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = stage(_star(stage(_star(now, True), "links"), False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
