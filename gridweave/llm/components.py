"""Connected components of a link table, as Spark joins and aggregations.

Alternates the two steps of the star contraction by Kiveris et al.,
"Connected Components in MapReduce and Beyond" (2014): a large-star step
hangs every larger neighbour of a node on the smallest of its neighbourhood,
a small-star step does so for the smaller ones. Each step is one aggregation
(the minimum, combined before the shuffle) and one join, so a node with very
many neighbours is never gathered. Every step is staged; no link leaves the
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stage


def _star(links: DataFrame, both: bool) -> DataFrame:
    """``links`` are (u, v) with u > v. Hang neighbours on the smallest of each neighbourhood."""
    if both:  # large star: neighbours on both sides, the larger ones move
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = near.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # small star: the smaller neighbours and the node itself move
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of ``links`` (columns ``a``, ``b``): the smallest id it is linked with.

    Ids may be of any ordered type; null ends and self-links take no part.
    """
    now = stage(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    mark = None
    while True:
        now = stage(_star(stage(_star(now, True), "star"), False), "star")
        seen = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
