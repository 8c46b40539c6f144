"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is the component's smallest node.

    Alternating large-star and small-star. Links point from the larger node to the
    smaller one and every node has one to itself. The large star moves each link's
    end to the smallest node that its end points to; the small star links all that
    a node points to with the smallest of them. Both keep components and lower the
    links, so there is always an end: every node points to its component's smallest
    and to nothing else. Rounds grow with the logarithm of the longest path, in
    whatever order the ids are, and links never become more. Each half round is
    written to the shared folder; the driver sees only whether a link moved.
    """
    own = links.select("a", F.col("a").alias("b")).union(links.select("b", F.col("b").alias("a")))
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(own).distinct(), "edges")
    while True:
        low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        far = edges.join(low, "b").groupBy("a", "low").agg(F.bool_or(F.col("b") > F.col("low")).alias("moved"))
        far = stash(far.withColumnRenamed("low", "b"), "edges")
        drop_stash(edges)
        low = far.groupBy("a").agg(F.min("b").alias("low"))
        above = F.col("b") > F.col("low")
        near = far.join(low, "a").groupBy(F.when(above, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"))
        edges = stash(near.agg((F.bool_or("moved") | F.bool_or(above)).alias("moved")), "edges")
        drop_stash(far)
        if edges.filter("moved").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
