"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt into shards; each pair of a query block and a
shard is a tile whose scores are one matrix product. A tile keeps the best k of
each query, and the lists are merged as a tree, a few shards at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import map_groups, matrix, materialize


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer matrices: in doubles where all sums are exact, else in whole numbers, held to the long range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole_a, whole_b = np.vectorize(int, otypes=[object])(a), np.vectorize(int, otypes=[object])(b)
    return np.clip(whole_a @ whole_b.T, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k best, ties to the smaller id, where ``own`` holds left out."""
    order = np.argsort(ids, kind="stable")
    scores, own = scores[:, order], own[:, order]
    room = min(k + int(own.sum(1).max(initial=0)), scores.shape[1])
    if room < scores.shape[1]:
        floor = np.partition(scores, scores.shape[1] - room, axis=1)[:, scores.shape[1] - room]
        r, c = np.nonzero((scores >= floor[:, None]) & ~own)
    else:
        r, c = np.nonzero(~own)
    by = np.lexsort((c, -scores[r, c], r))
    r, c = r[by], c[by]
    rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
    keep = rank < k
    return r[keep], order[c[keep]]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that have both and finite components only."""
    x = F.col("vector")
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return own.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 4096, fan_in: int = 16) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of its ``k`` best others.

    Components x count as floor(256 * x); the score is the integer inner
    product (held to the long range). Rows that are null, or hold null or
    non-finite components, take no part. A row is every other row's candidate,
    also where rows repeat or share an id: each of them then asks and is found
    on its own. Vectors of different length aren't compared. Fewer than
    ``k`` others: all of them; an empty table gives no rows; other columns
    play no part, whatever their names.

    Each tile is a task's small piece of work, and the partial lists of
    ``fan_in`` shards at a time are merged, so that no task holds more than
    ``fan_in * k`` rows of a query.
    """
    rows = valid_vectors(df, id_col, vector_col).select("vec_id", F.transform("vector", lambda v: F.floor(v * 256).cast("double")).alias("q"))
    rows = materialize(rows.withColumns({"dim": F.size("q").cast("long"), "row": F.monotonically_increasing_id()}))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(64, -(-n // tile)), max(1, -(-n_queries // tile))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    block = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks))
    candidates = rows.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), shard.alias("shard"), F.lit(False).alias("asks"), "row", "vec_id", "q")
    asking = rows.where(F.col("vec_id") % every == 0).select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "row", "vec_id", "q")

    def one_tile(key: dict, t: pa.Table) -> dict | None:
        asks = t["asks"].to_numpy()
        if asks.all() or not asks.any():
            return None
        row, ids, q = t["row"].to_numpy(), t["vec_id"].to_numpy(), matrix(t["q"])
        r, c = best_of(scores := exact_scores(q[asks], q[~asks]), ids[~asks], row[asks][:, None] == row[~asks][None, :], k)
        return {"row": row[asks][r], "query_id": ids[asks][r], "dim": np.full(len(r), key["dim"]), "shard": np.full(len(r), key["shard"]), "vec_id": ids[~asks][c], "score": scores[r, c]}

    lists = map_groups(candidates.unionByName(asking), ["dim", "block", "shard"], one_tile, "row long, query_id long, dim long, shard long, vec_id long, score long")
    while True:
        shards = -(-shards // fan_in)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
        order = Window.partitionBy("row", "dim", "shard").orderBy(F.desc("score"), "vec_id") if shards > 1 else Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
