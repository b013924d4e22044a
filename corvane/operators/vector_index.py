"""An index of vectors on disk, and exact batch search that skips what the triangle inequality rules out.

Vectors are laid out by their nearest pivot and their distance to it, in rings of
bounded size. Each ring keeps its least and greatest distance to every pivot. As lengths are one,
cosine similarity falls with the distance, and a query that lies ``d`` from a pivot is at least ``d - far`` and
``near - d`` from all of a ring. The rings of the least such bounds are compared first; the
k-th similarity that they give is a threshold, and rings that can't reach it are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.search import top_k, unit_rows
from corvane.sources.folders import stored, workspace

#: Digits to which similarities count, and what rounding may move a distance.
DIGITS, SLACK = 9, 1e-6
PLACE_BITS = 33


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, all finite and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``sample`` far from each other: each next one is the farthest from those before."""
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 1e-9:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))


@dataclass(frozen=True)
class VectorIndex:
    """A written index: ``path``, the vectors' ``width``, the columns by which searches may be kept apart, and the pivots."""

    spark: SparkSession
    path: str
    width: int
    within: tuple[str, ...]
    pivots: tuple[tuple[float, ...], ...]

    @classmethod
    def build(cls, vectors: DataFrame, width: int, path: str | None = None, within: list[str] | None = None, pivots: int = 32, ring: int = 256, sample: int = 2000) -> VectorIndex:
        """Writes the index of ``vectors`` (vec_id, embedding and the columns ``within``).

        Vectors that are null, zero, of another width or hold null or non-finite components take no part, nor do null
        ids; rows that repeat an id are vectors of their own. The pivots come from the ``sample`` vectors that a digest of
        the id puts first, which alone reach the driver; every vector is indexed. An empty table makes an index that finds nothing.
        """
        spark, path, within = vectors.sparkSession, path or workspace(vectors.sparkSession, "index"), within or []
        own = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), width)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *within)
        drawn = own.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        units = unit_rows(pa.array([r.embedding for r in drawn], pa.list_(pa.float64())), width)[0]
        chosen = spread_pivots(units, pivots) if len(units) else np.zeros((0, width))
        made = cls(spark, path, width, tuple(within), tuple(map(tuple, chosen.tolist())))
        settings = "width int, within array<string>, pivots array<array<double>>"
        spark.createDataFrame([(width, within, chosen.tolist())], settings).coalesce(1).write.parquet(f"{path}/settings")
        placed = stored(made._nearest(own))
        dealt = placed.repartitionByRange("cell", "distance", "vec_id").sortWithinPartitions("cell", "distance", "vec_id").withColumn("place", F.monotonically_increasing_id())
        number = F.shiftright("place", PLACE_BITS) * (1 << 24) + F.floor(F.col("place") % (1 << PLACE_BITS) / ring)
        dealt.select(number.cast("long").alias("ring"), "vec_id", "embedding", *within).write.parquet(f"{path}/vectors")
        made._ring_bounds().write.parquet(f"{path}/rings")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        s = spark.read.parquet(f"{path}/settings").first()
        return cls(spark, path, s.width, tuple(s.within), tuple(map(tuple, s.pivots)))

    def _pivots(self) -> np.ndarray:
        return np.array(self.pivots).reshape(-1, self.width)

    def _nearest(self, own: DataFrame) -> DataFrame:
        pivots, width, at = self._pivots(), self.width, own.columns.index("embedding")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", cell int, distance double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(unit_rows(batch.column(at), width)[0], pivots)
                cell = d.argmin(1) if len(d) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "distance"])

        return own.mapInArrow(run, schema)

    def _ring_bounds(self) -> DataFrame:
        """ring, near, far: the least and greatest distances of a ring to each pivot."""
        pivots, width = self._pivots(), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(unit_rows(batch.column(1), width)[0], pivots)
                rings, start = np.unique(batch.column(0).to_numpy(), return_index=True) if len(d) else (np.zeros(0, np.int64), np.zeros(0, int))
                order = np.argsort(start)  # rows of a ring stand together
                rings, start = rings[order], start[order]
                near, far = (np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)) if len(d) else (d, d)
                m, n = len(pivots), len(rings)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rings, m)), pa.array(np.tile(np.arange(m), n), pa.int32()), pa.array(near.ravel()), pa.array(far.ravel())], names=["ring", "pivot", "near", "far"])

        parts = self.spark.read.parquet(f"{self.path}/vectors").select("ring", "embedding").mapInArrow(run, "ring long, pivot int, near double, far double")
        per = parts.groupBy("ring", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"))
        line = per.groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("pivot", "near", "far"))).alias("p"))  # as many as there are pivots
        return line.select("ring", F.transform("p", lambda x: x["near"]).alias("near"), F.transform("p", lambda x: x["far"]).alias("far"))

    def _bounded(self, queries: DataFrame, keep, schema: str, tile: int, group: int) -> DataFrame:
        """What ``keep`` makes of tiles of queries and groups of rings: of their rows and the matrix of least distances."""
        rings = self.spark.read.parquet(f"{self.path}/rings")
        tiles, groups = (max(1, -(-df.count() // size)) for df, size in ((queries, tile), (rings, group)))
        left = queries.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = rings.withColumn("group", F.pmod(F.xxhash64("ring"), F.lit(groups)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
        pivots, width = self._pivots(), self.width

        def run(asked: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or rings.empty:
                return keep(asked.head(0), rings.head(0), np.zeros((0, 0)))
            d = distances(unit_rows(pa.array(asked["embedding"].to_list(), pa.list_(pa.float64())), width)[0], pivots)
            near, far = np.array(rings["near"].to_list()), np.array(rings["far"].to_list())
            bound = np.zeros((len(asked), len(rings)))
            for j in range(d.shape[1]):
                np.maximum(bound, np.maximum(d[:, j, None] - far[None, :, j], near[None, :, j] - d[:, j, None]), out=bound)
            return keep(asked, rings, bound)

        return left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group")).applyInPandas(run, schema)

    def _asked(self, queries: DataFrame) -> DataFrame:
        good = queries.where(F.col("query_id").isNotNull() & usable(F.col("embedding"), self.width))
        return stored(good.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64(F.lit(0), *self.within).alias("key")))

    def search(self, queries: DataFrame, k: int = 10, first: int = 2, own_id: bool = False, strict: bool = False, tile: int = 256, group: int = 2048) -> DataFrame:
        """Each query's ``k`` nearest vectors by cosine: query_id, vec_id, similarity, rank; ties to the smaller vec_id.

        The same rows as a scan. ``queries``: query_id, embedding and the columns ``within``, which must be equal on both sides. A vector of
        the query's own id counts only with ``own_id``. A query vector that the index couldn't hold finds nothing, or,
        if ``strict``, raises ValueError, as does an index without vectors.
        """
        return self.trace(queries, k, first, own_id, strict, tile, group)[0]

    def trace(self, queries: DataFrame, k: int = 10, first: int = 2, own_id: bool = False, strict: bool = False, tile: int = 256, group: int = 2048) -> tuple[DataFrame, DataFrame]:
        """:meth:`search`'s rows and the (query_id, ring) pairs that were compared."""
        asked = self._asked(queries)
        if strict and (not self.pivots or asked.count() < queries.count()):
            raise ValueError("no usable semantic index for these queries")
        if not self.pivots:
            empty = asked.limit(0)
            return empty.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")), empty.select("query_id", F.col("query_id").alias("ring"))

        def closest(asked: pd.DataFrame, rings: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
            order = np.argsort(bound, axis=1, kind="stable")[:, :first]
            ids, ring = asked["query_id"].to_numpy(), rings["ring"].to_numpy()
            return pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "ring": ring[order].ravel(), "bound": np.take_along_axis(bound, order, 1).ravel()})

        heads = self._bounded(asked, closest, "query_id long, ring long, bound double", tile, group)
        seeds = stored(top_k(heads, first, ["bound", "ring"]).select("query_id", "ring"))
        found = stored(self._compare(seeds, asked, k, own_id, tile))
        least = top_k(found, k, [F.desc("similarity"), "vec_id"]).where(F.col("rank") == k).select("query_id", F.sqrt(2 - 2 * F.col("similarity")).alias("reach"))

        def within_reach(asked: pd.DataFrame, rings: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
            reach = asked["reach"].to_numpy(float) if len(asked) else np.zeros(0)
            q, r = np.nonzero(bound <= np.where(np.isnan(reach), np.inf, reach + SLACK)[:, None])
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "ring": rings["ring"].to_numpy()[r]})

        reachable = self._bounded(asked.join(least, "query_id", "left"), within_reach, "query_id long, ring long", tile, group)
        rest = stored(reachable.join(seeds.select(F.col("query_id"), F.col("ring")), ["query_id", "ring"], "left_anti"))
        hits = found.unionByName(self._compare(rest, asked, k, own_id, tile))
        return top_k(hits, k, [F.desc("similarity"), "vec_id"]), seeds.unionByName(rest)

    def _compare(self, pairs: DataFrame, asked: DataFrame, k: int, own_id: bool, tile: int) -> DataFrame:
        """query_id, vec_id, similarity of the ``k`` best of each pair's ring; a ring and a tile of queries are one product."""
        tiles = max(1, -(-asked.count() // tile))
        left = pairs.join(asked, "query_id").withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)))
        needed = left.select("ring", "tile").distinct().toDF("in_ring", "in_tile")
        vectors = self.spark.read.parquet(f"{self.path}/vectors").select("ring", "vec_id", F.col("embedding").alias("other"), F.xxhash64(F.lit(0), *self.within).alias("other_key"))
        right = vectors.join(needed, F.col("ring") == F.col("in_ring")).withColumn("tile", F.col("in_tile") + 0).drop("in_ring", "in_tile")
        width = self.width

        def product(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or held.empty:
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
            rows = lambda c: unit_rows(pa.array(c.to_list(), pa.list_(pa.float64())), width)[0]
            ids = held["vec_id"].to_numpy()
            value = np.round(rows(asked["embedding"]) @ rows(held["other"]).T, DIGITS)
            counts = asked["key"].to_numpy()[:, None] == held["other_key"].to_numpy()
            if not own_id:
                counts &= asked["query_id"].to_numpy()[:, None] != ids
            value = np.where(counts, value, -np.inf)
            order = np.lexsort((np.broadcast_to(ids, value.shape), -value), axis=1)[:, :k]
            best = np.take_along_axis(value, order, 1)
            q, c = np.nonzero(best > -np.inf)
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "vec_id": ids[order[q, c]], "similarity": best[q, c]})

        return left.groupBy("ring", "tile").cogroup(right.groupBy("ring", "tile")).applyInPandas(product, "query_id long, vec_id long, similarity double")


def search_generations(asked: list[tuple[VectorIndex, DataFrame]], k: int = 10, over_fetch: int = 1, allowed: DataFrame | None = None, strict: bool = False, own_id: bool = False) -> DataFrame:
    """The ``k`` best over several generations of an index, each with its own queries' vectors: query_id, vec_id, similarity, rank.

    Each generation gives ``k * over_fetch`` hits (``k`` at least), of which those in ``allowed`` (vec_id) stay; a
    vector found in more than one counts once, with its greatest similarity. Without a generation there are no
    hits to give: ``strict`` raises ValueError, as callers that must not fall back want it.
    """
    if not asked:
        raise ValueError("no generation of a semantic index")
    hits = None
    for index, queries in asked:
        own = index.search(queries, max(k, k * over_fetch), own_id=own_id, strict=strict).drop("rank")
        hits = own if hits is None else hits.unionByName(own)
    if allowed is not None:
        hits = hits.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    merged = hits.groupBy("query_id", "vec_id").agg(F.max("similarity").alias("similarity"))
    return top_k(merged, k, [F.desc("similarity"), "vec_id"])
