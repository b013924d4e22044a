"""Fusion of ranked lists, diversity, parents, and the trace of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse_fast(hits: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of hits (query_id, list_idx, rank, chunk_id, ...): query_id, chunk_id, rrf, rrf_rank, first_list, first_rank.

    A chunk that a list holds twice counts twice; ties keep the order in which
    chunks were first seen, then by id.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "first_list", "first_rank", "chunk_id")
    seen = F.min(F.struct("list_idx", "rank"))
    out = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), seen.alias("s"))
    out = out.select("query_id", "chunk_id", "rrf", F.col("s.list_idx").alias("first_list"), F.col("s.rank").alias("first_rank"))
    out = out.withColumn("rrf_rank", F.row_number().over(w))
    return out.where(F.col("rrf_rank") <= limit) if limit else out


def fuse_deep(hits: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Fusion with each list rid of repeats first, so that ranks advance on new chunks only.

    Order: score, best rank, best raw score, id. Returns also the raw score and
    the sources of the hit that is kept, the one with the highest raw score.
    """
    first = hits.groupBy("query_id", "list_idx", "chunk_id").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_idx").orderBy("rank", "chunk_id")))
    out = again.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.sort_array(F.collect_set("list_idx")).alias("routes")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "best_rank", F.desc("best_score"), "chunk_id")
    out = out.withColumn("rrf_rank", F.row_number().over(w))
    return out.where(F.col("rrf_rank") <= limit) if limit else out


def protect_routes(ranked: DataFrame, limit: int, routes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The best hit of each route pinned first, then the rest in order, at most ``limit``: adds final_rank.

    ``ranked`` has query_id, chunk_id, rank and routes (list numbers).
    """
    out = ranked
    for i in routes:
        has = F.array_contains("routes", i)
        out = out.withColumn(f"pin_{i}", has & (F.col("rank") == F.min(F.when(has, F.col("rank"))).over(Window.partitionBy("query_id"))))
    pin = F.coalesce(*[F.when(F.col(f"pin_{i}"), F.lit(n)) for n, i in enumerate(routes)], F.lit(len(routes)))
    w = Window.partitionBy("query_id").orderBy(pin, "rank", "chunk_id")
    return out.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= limit).drop(*[f"pin_{i}" for i in routes])


def select_parents(ranked: DataFrame, limit: int) -> DataFrame:
    """The first hit of each parent in rank order, at most ``limit`` parents a query; hits without a parent don't count."""
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank", "chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    own = ranked.where(F.col("parent_id").isNotNull()).withColumn("n", F.row_number().over(first)).where("n = 1")
    return own.withColumn("parent_rank", F.row_number().over(order)).where(F.col("parent_rank") <= limit).drop("n")


def expand_parents(ranked: DataFrame, parents: DataFrame, limit: int = 8) -> DataFrame:
    """The first hit of each group (its parent, or itself), its text replaced by the parent's, its score kept."""
    group = F.coalesce("parent_id", "chunk_id")
    own = ranked.withColumn("group_id", group)
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("rank", "chunk_id"))).where("n = 1").drop("n")
    own = own.withColumn("group_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("group_rank") <= limit)
    p = parents.select(F.col("chunk_id").alias("group_id"), F.col("text").alias("parent_text"))
    return own.join(p, "group_id", "left").withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")


def citation_anchors(children: DataFrame) -> DataFrame:
    """The best-scoring child of each packed parent; ties keep the earlier one."""
    return children.where(F.col("parent_id").isNotNull()).groupBy("query_id", "parent_id").agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("rank"))).alias("anchor_chunk_id"))


def trace(keyword: DataFrame, semantic: DataFrame, fused: DataFrame, packed: DataFrame) -> DataFrame:
    """One row for each chunk that any list of a query holds: its ranks in each and whether it, or its parent, was packed."""
    keys = ["query_id", "chunk_id"]
    out = keyword.select(*keys, F.col("rank").alias("keyword_rank")).join(semantic.select(*keys, F.col("rank").alias("semantic_rank")), keys, "full")
    out = out.join(fused.select(*keys, "rrf", "rrf_rank"), keys, "full")
    return out.join(packed.select(*keys, F.lit(True).alias("accepted")).distinct(), keys, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def first_ranks(hits: DataFrame, order: list[Column | str]) -> DataFrame:
    """Ranks from list order: each chunk at its first place, counted from 1."""
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("n = 1").drop("n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
