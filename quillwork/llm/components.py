"""Connected components of a table of links, by alternating star steps.

A large-star step links every neighbour above a node to the smallest node
around it; a small-star step links a node and its smaller neighbours to the
smallest of them. Alternating them leaves one star a component after a number
of rounds that grows with the logarithm of the links. Every step is a map-side
combined minimum and an equi-join, which Spark may split where a hub is hot;
each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.shared import shared_folder


def connected(links: DataFrame) -> DataFrame:
    """node, root of every linked node; root is the smallest node of its component.

    links has long columns a and b; loops and repeats don't matter. Nodes
    without a link to another node aren't in the result.
    """
    shared_folder(links.sparkSession)
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = links.where("a <> b").select(high, low).distinct().checkpoint()
    seen = None
    while True:
        n, mix = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mix) == seen or n == 0:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = (n, mix)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = small.where("e.u <> e.m").select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).distinct().checkpoint()
