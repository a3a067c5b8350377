"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (``a``, ``b``).

    Large-star and small-star steps in turn (Kiveris et al. 2014): links move from a node's neighbours to the least
    of them, so that the number of links never grows and a long chain halves each time. Each round is
    written to the checkpoint folder; what comes to the driver is a count.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are written first: the joins then meet plain shuffles, whose hot nodes AQE can split.
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        # Done when every node hangs on a root: no node has two parents, and no parent has a parent.
        if after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            break
        links = after
    roots = after.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
