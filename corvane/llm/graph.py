"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for each end of ``edges`` (long src, dst): the smallest node that links reach.

    Alternates large-star and small-star steps until the links are stars around
    their smallest nodes. Each round is a written table; only a count and a
    checksum of it reach the driver. Loops give their node; no edges, no rows.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e)
    loops = e.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    links = e.where(F.col("u") != F.col("v"))
    before = None
    for _ in range(rounds):
        links = materialize(small_star(large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.withColumn("component", F.col("node"))
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
