"""Balancing of goals' rankings into one list of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse_phases(candidates: DataFrame, evidence: DataFrame, rerank_limit: float = 12.0, rrf_limit: float = 60.0) -> DataFrame:
    """A goal's candidates over its phases, with what evidence says of their documents.

    ``candidates``: run_id, goal_id, goal_order, phase, chunk_id, document_id,
    rrf_rank, rrf_score, rerank_rank, rerank_score. ``evidence``: run_id,
    goal_id, document_id, requirement_id, active. The normalized rank is the
    least of a rank's shares of its limit (999 without a rank).
    """
    keys = ["run_id", "goal_id", "document_id"]
    known = evidence.groupBy(*keys).agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("has_active"), F.count_distinct(F.when(F.col("active"), F.col("requirement_id"))).alias("covered"))
    ranked = candidates.where(F.col("rerank_rank").isNotNull() | F.col("rrf_rank").isNotNull()).join(known, keys, "left")
    share = F.least(F.coalesce(F.col("rerank_rank") / F.lit(rerank_limit), F.lit(999.0)), F.coalesce(F.col("rrf_rank") / F.lit(rrf_limit), F.lit(999.0)))
    return ranked.groupBy("run_id", "goal_id", "chunk_id", "document_id").agg(
        F.min("goal_order").alias("goal_order"),
        F.sum(F.lit(1.0) / (F.lit(60.0) + F.col("rrf_rank"))).alias("fusion"),
        F.min("rerank_rank").alias("best_rerank_rank"),
        F.max("rerank_score").alias("best_rerank_score"),
        F.max("rrf_score").alias("best_rrf_score"),
        F.min(share).alias("normal_rank"),
        F.coalesce(F.bool_or("has_active"), F.lit(False)).alias("has_active"),
        F.coalesce(F.max("covered"), F.lit(0)).alias("covered"),
    )


def balance_goals(fused: DataFrame, rerank_limit: float = 12.0, limit: int = 40, final: bool = True) -> DataFrame:
    """The run's documents, one goal's best after the other's: run_id, position, goal_id, document_id, chunk_id, balanced_rank, score.

    Chunks are ranked in their goal, the best chunk stands for its document,
    a document stays with the goal that ranks it best, and the goals' lists
    are ranked again and interleaved.
    """
    first_tier = F.col("has_active") | (F.col("best_rerank_rank") <= rerank_limit) if final else F.col("has_active")
    tier = F.when(first_tier, 0).otherwise(1)
    in_goal = Window.partitionBy("run_id", "goal_id")
    order = [tier, F.desc("has_active"), "normal_rank", F.desc_nulls_last("fusion"), F.desc_nulls_last("best_rerank_score"), F.desc_nulls_last("best_rrf_score"), F.desc("covered"), "chunk_id"]
    out = fused.withColumn("chunk_rank", F.row_number().over(in_goal.orderBy(*order)))
    best = Window.partitionBy("run_id", "goal_id", "document_id").orderBy("chunk_rank")
    out = out.withColumn("n", F.row_number().over(best)).where("n = 1")
    out = out.withColumn("document_rank", F.row_number().over(in_goal.orderBy("chunk_rank", "document_id")))
    seen = Window.partitionBy("run_id", "document_id").orderBy("document_rank", "goal_order", "goal_id", "chunk_id")
    out = out.withColumn("n", F.row_number().over(seen)).where("n = 1").drop("n")
    out = out.withColumn("balanced_rank", F.row_number().over(in_goal.orderBy("document_rank", "document_id")))
    line = Window.partitionBy("run_id").orderBy("balanced_rank", "goal_order", "goal_id", "chunk_id")
    out = out.withColumn("position", F.row_number().over(line)).where(F.col("position") <= limit)
    return out.select("run_id", "position", "goal_id", "document_id", "chunk_id", "balanced_rank", F.coalesce("best_rerank_score", "fusion", "best_rrf_score", F.lit(0.0)).alias("score"))


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def interleave(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """Rows one group after the other by their place in it (round robin), at most ``limit`` in all."""
    ranked = df.withColumn("depth", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.orderBy("depth", *group).limit(limit)
