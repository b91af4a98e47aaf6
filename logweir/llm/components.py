"""Connected components of a link table, by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), any order, repeats and self-links allowed. Returns (node, label) for every node in
    a link; label is the smallest node of its component.

    Each round hangs every node on the smallest of its neighbours (large star: the larger neighbours,
    small star: the others). Both only group and join; a hub's minimum is pre-aggregated.

    A hub's edges meet its minimum in a plain join, which Spark's adaptive skew join splits when a partition
    is large (spark.sql.adaptive.skewJoin); nothing is copied for the other nodes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    nodes = edges
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        after = written(small, "links")
        # stars when no node has two parents and no parent has one
        many = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        if not after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() and not many.limit(1).count():
            break
        edges = after
    members = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return members.join(after.toDF("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
