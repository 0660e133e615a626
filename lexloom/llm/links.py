"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the component is its smallest node.

    Alternating stars: each node hangs its larger neighbours, then its smaller ones, under the
    smallest node next to it, until every node hangs under a root; the number of rounds grows with
    the logarithm of a component's size, and a round writes one table. A node with very many
    neighbours is no hot spot: its minimum is aggregated before the shuffle and met again by a
    join that adaptive execution splits. Links of a node with itself and null ends are ignored.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
        held = ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        if held.where("under > 1 or (under = 1 and over = 1)").isEmpty():
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
