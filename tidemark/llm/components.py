"""Connected components of a link table, by joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table


def _toward_least(links: DataFrame, label: str) -> DataFrame:
    """One round. Each node sends its least neighbour to its other neighbours, first to those above it, then to those
    below it; links that repeat fall together."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = as_table(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
    down = up.groupBy("a").agg(F.min("b").alias("m"))
    return as_table(
        up.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(down.select("a", F.col("m").alias("b"))).distinct(), label)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that links reach.

    Links are turned into stars around the least node. The number of rounds grows with the logarithm of the size,
    and a node with many neighbours is aggregated before it is exchanged. Loops and nulls are ignored.
    """
    stars = as_table(links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        seen = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        stars = _toward_least(stars, label)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
