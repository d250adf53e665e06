"""Connected components of a table of links, by alternating star contractions.

Large-star hangs each node's larger neighbours on its smallest neighbour, small-star its
smaller ones; both are minima per node with map-side combination and a join back, so a
node with very many links is never one task's group. Components that are stars are finished
and leave the rounds; these are repeated until no other is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.common import keep


def unfinished(edges: DataFrame) -> DataFrame:
    """(v) of the links (u, v), u > v, whose components are not stars yet: of those with a node that has two smaller neighbours, or a
    smaller and a larger one, every v that such a node has or is."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(
        edges.select(F.col("v").alias("node"), F.lit(0), F.lit(1)))
    mixed = keep(nodes.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
                 .where("smaller > 0 and smaller + larger > 1").select("node"), "mixed")
    return keep(mixed.join(edges, F.col("node") == F.col("u")).select("v").union(mixed.select("node")).distinct(), "unfinished")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component: its smallest node."""
    edges = keep(links.where(F.col(a) != F.col(b))
                 .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    finished = []
    more = not edges.isEmpty()
    while more:
        # the least neighbours, one row a node, are the hashed side of the joins, so that the links need no sorting
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least.hint("shuffle_hash"), "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))  # repeats do no harm here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least.hint("shuffle_hash"), "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))
        edges = keep(small.distinct(), "stars")
        rest = unfinished(edges)
        more = not rest.isEmpty()
        if more:
            finished.append(edges.join(rest, "v", "left_anti").select("u", "v"))
            edges = keep(edges.join(rest, "v", "left_semi").select("u", "v"), "open")
    edges = reduce(DataFrame.union, finished, edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
