"""Connected components of a table of links, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import passing, written


@passing
def components(links: DataFrame) -> DataFrame:
    """links (a, b), longs without nulls -> (node, root), a row for each node that is linked; nodes of one component share the root.

    Each round, every node points to its neighbour of the least priority (a
    bijective hash, so that chains of similar values don't line up), pointers
    are followed twice, and the links are contracted to the roots. The rounds
    grow as the logarithm of the longest chain; only counts reach the driver.
    """
    edges = links.where("a <> b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    nodes = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("root")), "nodes")
    edges = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    while edges.limit(1).count():
        up = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            up = written(up.join(above, "up").select("node", F.col("above").alias("up")), "up")
        nodes = written(nodes.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = written(edges.join(a, "a").join(b, "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
    return nodes
