"""Connected components of a link table, by alternating star contraction on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, drop_table


def _towards_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours (all, or the smaller ones) point at the least of them and the node itself."""
    pairs = edges.select("u", "v")
    if both_ways:
        pairs = pairs.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("n"))
    if both_ways:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that is not its own root; the root is the least node.

    Minima are aggregated before the shuffle and joined back, which adaptive execution splits for a hot node. A round
    needs a few shuffles of the remaining edges, at most one per node after the first; rounds grow with the logarithm of
    a chain's length. The driver sees two numbers per round.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        wide = _towards_least(edges, True).where("u <> v").distinct()
        turned = cut_lineage(_towards_least(wide, False).distinct(), "links")
        drop_table(edges)
        edges = turned
