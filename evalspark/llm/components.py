"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import written


def _state(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return got["n"], got["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; the root is the smallest
    node that can be reached.

    Each round hangs a node's larger neighbours on its smallest neighbour
    (large star), then its smaller neighbours and itself on the smallest of
    them (small star). Links only ever move to smaller nodes, so their number
    doesn't grow; rounds needed grow with the logarithm of the longest chain.
    Minima are aggregated map side and joined back, so a node with very many
    links is split like any hot join key; each round is written to the shared
    folder, which cuts the lineage.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = written(links.filter("u <> v").select(low.alias("u"), high.alias("v")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("m").alias("u"), "v").filter("u <> v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = written(
            small.select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u <> v")
            .unionByName(small.select(F.col("m").alias("u"), "v")).distinct(), "links")
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
