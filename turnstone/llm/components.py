"""Connected components of a graph of links, as Spark jobs: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, of every node of ``links`` (``a``, ``b``; any order).

    Each step is written to the shared folder; only a count and a checksum reach the driver. Steps grow with the
    logarithm of the graph's size. A node with very many neighbours costs one partial minimum per task and a join
    whose partitions Spark splits.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(moved.select("e.*").filter("u <> v").distinct(), "links")
        # equal sums of two hashes and equal counts: the same edges
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))
