"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import remove, staged


def _minimum_links(pairs: DataFrame) -> DataFrame:
    """Each node with the least node among itself and its neighbours; aggregates before the exchange."""
    return pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component``: the least node that each linked node reaches.

    ``links`` holds undirected links between longs; nodes without links don't appear, self-links
    and repeats are allowed, null ends are ignored. Alternates large-star and small-star steps: each
    step hangs a node's neighbours below the least of them, so a component becomes a star in about
    log2(size) rounds. A node's neighbours are never gathered: the least one comes from a partial
    aggregate and joins back. Every round is a written table, so lost executors cost one round.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    edges, path = staged(edges, "links")
    before = None
    for _ in range(most_rounds):
        # Large star: the larger neighbours of a node go below the least of all its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minimum_links(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large, large_path = staged(large.distinct(), "large-star")
        # Small star: the smaller neighbours of a node, and itself, go below the least of them.
        low = _minimum_links(large)
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small, small_path = staged(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        remove(spark, path)
        remove(spark, large_path)
        edges, path = small, small_path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
