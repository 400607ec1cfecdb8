"""Connected components of a graph of links, by alternating star contraction.

Each round hangs the neighbours of every node on its smallest neighbour (first those above the node,
then those below it). The number of links never grows, and a component ends as a star around its
smallest node after a number of rounds that grows with the logarithm of its diameter. Rounds are
written to the shared staging folder; nothing is collected but a count and a checksum.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage_columns


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # every link points from the larger to the smaller node
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link in ``links`` (``a``, ``b``): the smallest node
    it reaches. Links of a node to itself, repeated and reversed links are fine."""
    own = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    own = stage_columns(own, "links")
    mark = _mark(own)
    while mark[0]:
        own = stage_columns(_small_star(_large_star(own)), "links")
        now = _mark(own)
        if now == mark:
            break
        mark = now
    centres = own.select(F.col("b").alias("node")).distinct()
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        centres.select("node", F.col("node").alias("component"))
    )
