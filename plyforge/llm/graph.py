"""Connected components of a table of links, by rounds of star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.session import checkpointed


def _mark(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.col("v") % (1 << 40))
    ).first()
    return tuple(row)


def components(links: DataFrame, a="a", b="b") -> DataFrame:
    """node and component (its smallest node) of every node with a link to another one.

    Each round joins the neighbours of a node to the smallest of them: first its larger
    neighbours, then its smaller ones. Edges never become more, minima are combined in each task
    before the shuffle, and the number of rounds grows with the logarithm of the longest path.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpointed(pair.where("u != v").distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _mark(edges)
        if now == mark:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = now
