"""Connected components of links too many for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlark.workspace import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b); the component is its smallest node.

    Large-star and small-star steps in turn: every node points to the smallest
    node it knows, which turns each component into a star within a number of
    rounds that grows with the logarithm of its size. Smallest neighbours are
    pre-aggregated, so a node with very many links is no hot key there; where
    its links are dealt out again, adaptive execution splits them. Each round
    is written to the shared folder. Self-links, repeated and reversed links
    are harmless; an empty table gives an empty table.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = written(links.select(a.alias("a"), b.alias("b")).where("a != b").distinct(), "links")
    fingerprint = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        # Large star: larger neighbours move to the smallest one.
        edges = written(
            both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct(),
            "links-large",
        )
        # Small star: a node and its smaller neighbours move to the smallest one.
        smallest = edges.groupBy("a").agg(F.min("b").alias("root"))
        moved = edges.join(smallest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b"))
        edges = written(moved.where("a != b").distinct(), "links-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now == fingerprint:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        fingerprint = now
