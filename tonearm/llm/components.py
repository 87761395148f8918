"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node on an edge ``a, b``.

    Large and small stars in turn: every node's larger, then smaller, neighbours are tied to its
    smallest one, until every larger end of an edge has that one neighbour only. Neighbours are only ever
    reduced to their minimum and maximum, so no list of a node's neighbours is built; a round's edges are
    written to the shared folder. Edges may repeat, point either way or lead back to their own
    node; none gives an empty table. The result is read from the shared folder.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
                        .select("a", F.least("a", "m").alias("m"), "most"), "least")
        if not least.where("m < a and most <> m").agg(F.count("*")).first()[0]:
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = written(both.join(least.select("a", "m"), "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smaller, "a").where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(smaller.withColumnRenamed("m", "b")).distinct(), "small-star")
