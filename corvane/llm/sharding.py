"""Sharding: range partitioning by sampled, size-weighted splitters.

A size-weighted key sample of bounded expected size gives quantile boundaries;
records are range-partitioned by them; ranges that turn out overfull are
sampled again and subdivided. Running sums inside the ranges, on top of the
ranges' exact totals, then place each record on the line of all bytes, and the
line is cut into equal shards, beside small groups of one key rather than through
them. So the cuts are exact, whatever the sample.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corvane.llm.common import materialize


#: A splitter: key, tie and sub of the records below it, which are less.
Splitter = tuple[int, int, int]
LEAST = -(1 << 63)


def find_range(key: np.ndarray, tie: np.ndarray, sub: np.ndarray, splitters: list[Splitter], split_key: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters lie below each record's (key, tie, sub)."""
    low = np.searchsorted(split_key, key, "left")
    high = np.searchsorted(split_key, key, "right")
    for i in np.flatnonzero(low != high):
        low[i] = bisect_left(splitters, (int(key[i]), int(tie[i]), int(sub[i])), int(low[i]), int(high[i]))
    return low


def sample_splitters(df: DataFrame, total: int, ranges: int, per_range: int, seed: int) -> list[Splitter]:
    """Boundaries of about ``ranges`` equal parts of ``df``'s bytes.

    A record is drawn with a probability in proportion to its size, by a hash
    of its key, so about ``ranges * per_range`` records reach the driver,
    however large the table is.
    """
    step = max(1.0, total / (ranges * per_range))
    draw = F.pmod(F.xxhash64("key", "tie", "sub", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    picked = df.where(draw < F.col("size") / F.lit(step)).select("key", "tie", "sub", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    got = sorted(tuple(r) for r in picked.collect())
    if not got:
        return []
    weight = np.cumsum([w for *_, w in got])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return sorted({got[i][:3] for i in at})


def beside_groups(df: DataFrame, splitters: list[Splitter], limit: float) -> list[Splitter]:
    """The splitters, those inside a group of at most ``limit`` bytes moved before it."""
    keys = sorted({k for k, *_ in splitters})
    sizes = {r.key: r.b for r in df.where(F.col("key").isin(keys)).groupBy("key").agg(F.sum("size").alias("b")).collect()}  # a row for each splitter
    return sorted({(k, LEAST, LEAST) if sizes.get(k, 0) <= limit else (k, t, u) for k, t, u in splitters})


def with_range(df: DataFrame, splitters: list[Splitter]) -> DataFrame:
    keys = df.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf(IntegerType())
    def part(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        split_key = np.array([k for k, *_ in keys.value], np.int64)
        for key, tie, sub in batches:
            yield pd.Series(find_range(key.to_numpy(), tie.to_numpy(), sub.to_numpy(), keys.value, split_key), dtype="int32")

    return df.withColumn("part", part("key", "tie", "sub"))


def assign_shards(df: DataFrame, n_shards: int = 8, ranges: int = 256, per_range: int = 64, seed: int = 7, rounds: int = 4, whole: float = 1 / 256) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    ``df`` has long, non-null columns key, tie, sub and size (positive): shards
    are consecutive ranges of (key, tie, sub) of equal bytes. Records of one
    key that have at most ``whole`` of a shard's bytes stay together, so sizes
    differ by less than that and two records' sizes; a greater group goes to as many
    shards as its bytes need. Records that are alike in key and tie are split
    by sub, so no range stays overfull. Repeated rows each get a slot. A
    table without rows gives none.

    Bounded on the driver: about ``ranges * per_range`` sampled keys and one
    line for each range. Each range is sorted in one task.
    """
    total = df.agg(F.sum("size")).first()[0] or 0
    limit = total * whole / n_shards
    splitters = beside_groups(df, sample_splitters(df, total, ranges, per_range, seed), limit)
    for again in range(rounds):
        dealt = with_range(df, splitters)
        load = {r.part: (r.n, r.b) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
        over = [p for p, (n, b) in load.items() if b > 2 * total / ranges and n > 1]
        if not over or again == rounds - 1:
            break
        more = sample_splitters(dealt.where(F.col("part").isin(over)), sum(load[p][1] for p in over), 4 * len(over), per_range, seed + again + 1)
        grown = sorted({*splitters, *beside_groups(df, more, limit)})
        if len(grown) == len(splitters):
            break
        splitters = grown

    rows_before, bytes_before, starts = 0, 0, []
    for p in sorted(load):
        starts.append((p, rows_before, bytes_before))
        rows_before, bytes_before = rows_before + load[p][0], bytes_before + load[p][1]
    offsets = df.sparkSession.createDataFrame(starts, "part int, rows_before long, bytes_before long")
    order = Window.partitionBy("part").orderBy("key", "tie", "sub", "size")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("part", "key")
    middle = F.when(F.col("of_group") <= limit, F.col("group_start") * 2 + F.col("of_group")).otherwise(F.col("ends") * 2 - F.col("size"))
    placed = (
        dealt.withColumns({"row_in": F.row_number().over(order), "bytes_in": F.sum("size").over(inside)})
        .join(F.broadcast(offsets), "part")  # one row for each range: bounded by the parameters
        .withColumn("place", F.col("rows_before") + F.col("row_in") - 1)
        .withColumn("ends", F.col("bytes_before") + F.col("bytes_in"))
        .withColumns({"of_group": F.sum("size").over(group), "group_start": F.min(F.col("ends") - F.col("size")).over(group)})
        .withColumn("twice", middle)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(twice * {n_shards}) div (2 * {max(total, 1)})")).cast("int"))
        .drop("part", "row_in", "bytes_in", "rows_before", "bytes_before", "ends", "of_group", "group_start", "twice")
    )
    placed = materialize(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("place", "first")  # a row for each shard


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """Documents in shards of near equal bytes (law ``bytes``), equal texts side by side.

    Size is the text's UTF-8 bytes plus 1; a null text has size 1. The key is a
    digest of the text, so that a shard is a random sample of the texts and
    copies meet; the id orders a group of copies (a null id sorts as the least
    long), and rows that repeat id and text are told apart by their place in the
    table. ``carry`` names columns that go along, whatever their names (none:
    only ids and sizes are shuffled); others play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).alias(f"carried_{c}") for c in carry or []],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("tie"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).alias("sub"),
    )
    own = materialize(own)
    out = assign_shards(own, n_shards, **options)
    return out.select("doc_id", *[F.col(f"carried_{c}").alias(c) for c in carry or []], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, carry: list[str] | None = None, **options) -> None:
    """Documents as Parquet under ``path``/shard=N, each file sorted by slot."""
    out = shard_documents(docs, n_shards, carry=carry or ["text"], **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
