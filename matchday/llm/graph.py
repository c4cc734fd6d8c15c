"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node of `links(a, b)`; `label` is the least node it is connected with.

    Alternating stars: every node's larger neighbours are tied to its least
    neighbour, then its smaller ones to the least of them, until each component
    is one star. All steps are aggregates and joins on node ids; a hub is
    pre-aggregated and its join may be split, no node's neighbours are gathered.
    """
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    e = common.checkpointed(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                            .filter("hi != lo").distinct())
    now = state(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
                 .union(low.select("hi", F.col("m").alias("lo"))).distinct())
        e = common.checkpointed(small)
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
