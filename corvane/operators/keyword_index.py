"""An inverted index on disk, and batch top-k search that skips blocks by their bounds.

The index is a folder of Parquet tables, written once and read by each search.
Chunks are put in order by which of the most frequent terms they hold, and runs of them make blocks of
bounded size: chunks of a block are alike in the terms that would otherwise lift every block's bound. A row of
``postings`` is a term in a block: the block's chunks that hold it, each one's
impact, and the greatest of these. A query's bound for a block is the sum of its terms'
greatest impacts there, each by the term's weight. The blocks of the greatest bounds are scored first; the k-th score
that they give is a threshold, and blocks whose bound stays below it are never read.
Documents that come later are a segment of their own beside the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.search import top_k
from corvane.sources.folders import stored, workspace

#: Saturation and length parameters of BM25 (fixed values).
K1, B = 1.2, 0.75
#: Digits to which scores count, so that sums in another order give equal ties.
DIGITS = 9
#: Bits of a row's place in its partition in an increasing id of Spark (a fixed value), and frequent terms that order the chunks.
PLACE_BITS, FREQUENT = 33, 62
#: Blocks that meet a tile of queries in one group.
SPAN = 32


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class KeywordIndex:
    """A written index: ``path`` and how it scores.

    ``scoring`` is ``share`` (of a query's distinct terms, those that a chunk
    holds) or ``bm25``, whose mean length is that of the first segment from then on.
    """

    spark: SparkSession
    path: str
    scoring: str
    mean_length: float
    segments: int

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, scoring: str = "share", block: int = 64) -> KeywordIndex:
        """Writes the index of ``chunks`` (chunk_id, text) and returns it. ``block`` is the chunks of a block, a power of two.

        A null chunk_id isn't indexed, a null text has no terms, and rows that share an id are chunks of that
        id, each for itself. An empty table makes an index that finds nothing.
        """
        if scoring not in ("share", "bm25"):
            raise ValueError(f"no such scoring: {scoring}")
        spark = chunks.sparkSession
        path = path or workspace(spark, "index")
        words = chunks.where("chunk_id IS NOT NULL").select(F.explode(F.array_distinct(word_list(F.col("text")))).alias("term"))
        frequent = [r.term for r in words.groupBy("term").count().orderBy(F.desc("count"), "term").limit(FREQUENT).collect()]
        cls._write_chunks(chunks, path, 0, block, frequent)
        mean = spark.read.parquet(f"{path}/chunks").agg(F.avg("length")).first()[0] or 1.0
        settings = "scoring string, mean_length double, block int, frequent array<string>"
        spark.createDataFrame([(scoring, float(mean), block, frequent)], settings).coalesce(1).write.parquet(f"{path}/settings")
        return cls(spark, path, scoring, float(mean), 1)._write_postings(0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        """The index at ``path``."""
        s = spark.read.parquet(f"{path}/settings").first()
        segments = spark.read.parquet(f"{path}/terms").agg(F.max("segment")).first()[0]
        return cls(spark, path, s.scoring, s.mean_length, 1 if segments is None else segments + 1)

    def append(self, chunks: DataFrame) -> KeywordIndex:
        """The index with ``chunks`` as one more segment; what is there isn't read or written."""
        s = self.spark.read.parquet(f"{self.path}/settings").first()
        self._write_chunks(chunks, self.path, self.segments, s.block, s.frequent)
        return KeywordIndex(self.spark, self.path, self.scoring, self.mean_length, self.segments + 1)._write_postings(self.segments)

    @staticmethod
    def _write_chunks(chunks: DataFrame, path: str, segment: int, block: int, frequent: list[str]) -> None:
        """The forward table: chunk_id, place, block, length, terms with their counts. Blocks are runs of a partition of a range of the order."""
        counted = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), (F.size("words") - F.size(F.array_remove("words", t))).alias("count")))
        own = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
        known = F.array(*[F.lit(t) for t in frequent]).cast("array<string>")
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(FREQUENT) - F.array_position(known, t)).cast("int"))
        alike = F.aggregate(F.array_intersect(word_list(F.col("text")), known), F.lit(0).cast("long"), lambda acc, t: acc + bit(t))
        # texts move, and their words are found again where they come to: lists of words take several times as much
        dealt = own.withColumn("alike", alike).repartitionByRange(F.desc("alike"), "chunk_id").sortWithinPartitions(F.desc("alike"), "chunk_id").withColumn("place", F.monotonically_increasing_id())
        dealt = dealt.withColumn("words", word_list(F.col("text")))
        number = F.shiftright("place", PLACE_BITS) * (1 << 24) + F.floor(F.col("place") % (1 << PLACE_BITS) / block)
        made = dealt.select("chunk_id", "place", number.cast("long").alias("block"), F.size("words").alias("length"), counted.alias("terms"))
        made.write.option("compression", "zstd").parquet(f"{path}/chunks/segment={segment}")

    def _write_postings(self, segment: int) -> KeywordIndex:
        """Postings, each file's in the order of terms and blocks, and a line for each term. Blocks are dealt to files: chunks move to their block's place before they are taken apart, and a bound is summed where its block lies."""
        own = self.spark.read.parquet(f"{self.path}/chunks/segment={segment}").repartition("block").select("chunk_id", "place", "block", "length", F.explode("terms").alias("t"))
        count = F.col("t.count").cast("double")
        impact = F.lit(1.0) if self.scoring == "share" else count * (K1 + 1) / (count + K1 * (1 - B + B * F.col("length") / self.mean_length))
        per = own.select(F.col("t.term").alias("term"), "block", F.struct("place", "chunk_id", impact.alias("impact")).alias("posting")).groupBy("term", "block").agg(F.array_sort(F.collect_list("posting")).alias("p"))  # at most ``block`` of them
        rows = per.select("term", "block", F.array_max(F.transform("p", lambda x: x["impact"])).alias("most"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("p", lambda x: x["place"]).alias("places"), F.transform("p", lambda x: x["impact"]).alias("impacts"))
        rows.sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{self.path}/postings/segment={segment}")
        back = self.spark.read.parquet(f"{self.path}/postings/segment={segment}")
        back.groupBy("term").agg(F.sum(F.size("chunk_ids")).cast("long").alias("df"), F.max("most").alias("most")).write.parquet(f"{self.path}/terms/segment={segment}")
        return self

    def table(self, name: str) -> DataFrame:
        """``chunks``, ``postings`` or ``terms`` of this index's segments."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment") < self.segments)

    def statistics(self) -> DataFrame:
        """term, df (chunks that hold it) and the greatest impact, over all segments."""
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """query_id, term, weight of ``queries``' distinct terms; terms that the index doesn't have weigh on others' shares only."""
        asked = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(word_list(F.col("text"))).alias("t"))
        terms = asked.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
        if self.scoring == "share":
            return terms.groupBy("query_id", "term").agg((F.lit(1.0) / F.max("n")).alias("weight"))
        chunks = self.table("chunks").count()
        known = terms.select("query_id", "term").distinct().join(self.statistics(), "term")
        return known.select("query_id", "term", F.log(1 + (F.lit(float(chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))

    def bounds(self, weights: DataFrame) -> DataFrame:
        """query_id, segment, block, bound: what no chunk of the block can pass. Only terms, blocks and greatest impacts are read."""
        heads = self.table("postings").select("segment", "block", "term", "most")
        met = weights.join(heads, "term")
        return met.groupBy("query_id", "segment", "block").agg(F.round(F.sum(F.col("weight") * F.col("most")), DIGITS).alias("bound"))

    def search(self, queries: DataFrame, k: int = 30, first: int = 4, tile: int = 256) -> DataFrame:
        """Each query's ``k`` best chunks: query_id, chunk_id, score, rank; ties to the smaller chunk_id.

        ``queries``: query_id, text. The same rows as a scan of all chunks: a block is left out only if its bound
        is below a score that ``k`` chunks reach. A query without terms, or whose terms the
        index doesn't have, has no rows. The plan's size doesn't depend on the number of queries; ``tile`` queries meet a block at once.
        """
        return self.trace(queries, k, first, tile)[0]

    def trace(self, queries: DataFrame, k: int = 30, first: int = 4, tile: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
        """:meth:`search`'s rows, all (query, block) pairs with their bounds, and those pairs that were scored."""
        weights = stored(self.weights(queries))
        bounds = stored(self.bounds(weights))
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        seeds = stored(bounds.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= first).drop("n"))
        found = stored(self.score(seeds, weights, k, tile))
        least = top_k(found, k, [F.desc("score"), "chunk_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        open_ = bounds.join(seeds.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti").join(least, "query_id", "left")
        rest = stored(open_.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least"))
        out = found.unionByName(self.score(rest, weights, k, tile))
        return top_k(out, k, [F.desc("score"), "chunk_id"]), bounds, seeds.unionByName(rest)

    def score(self, pairs: DataFrame, weights: DataFrame, k: int, tile: int = 256) -> DataFrame:
        """query_id, chunk_id, score of the ``k`` best chunks of each pair's block.

        A span of blocks with their postings of the queries' terms meets a tile of queries in one group: both are
        bounded, a query's terms are there once for all blocks of the span, and a block's scores are one matrix product.
        """
        keys = ["segment", "span", "tile"]
        tiles = F.ceil(F.approx_count_distinct("query_id") / tile)
        count = max(1, weights.agg(tiles).first()[0] or 1)
        span = F.floor(F.col("block") / SPAN)
        dealt = pairs.select("query_id", "segment", "block", span.alias("span"), F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int").alias("tile"))
        asked = weights.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        none = lambda t: F.lit(None).cast(t)
        left = dealt.withColumns({"terms": none("array<string>"), "weights": none("array<double>")}).unionByName(
            dealt.select("query_id", *keys).distinct().join(asked, "query_id").withColumn("block", none("long"))
        )
        needed = dealt.select("segment", "block", "tile").distinct().toDF("in_segment", "in_block", "in_tile")
        own = self.table("postings").join(weights.select("term").distinct(), "term", "left_semi").select("segment", "block", "term", "chunk_ids", "places", "impacts")
        right = own.join(needed, (F.col("segment") == F.col("in_segment")) & (F.col("block") == F.col("in_block"))).withColumns({"tile": F.col("in_tile") + 0, "span": span}).drop("in_segment", "in_block", "in_tile")

        def products(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            own = asked[asked["block"].isna()].set_index("query_id")[["terms", "weights"]]
            blocks = dict(iter(held.groupby("block")))
            each = asked[asked["block"].notna()].groupby("block")["query_id"]
            made = [product(own.loc[ids].reset_index(), blocks.get(block, held.iloc[:0])) for block, ids in each]
            return pd.concat(made, ignore_index=True) if made else product(asked.iloc[:0], held.iloc[:0])

        def product(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            columns = ["query_id", "chunk_id", "score"]
            if asked.empty or held.empty:
                return pd.DataFrame(columns=columns).astype({"query_id": "int64", "chunk_id": "int64", "score": "float64"})
            row_of = {t: i for i, t in enumerate(held["term"])}
            places, at = np.unique(np.concatenate(held["places"].to_list()), return_inverse=True)
            sizes = held["places"].map(len).to_numpy()
            impacts = np.zeros((len(row_of), len(places)))
            impacts[np.repeat(np.arange(len(sizes)), sizes), at] = np.concatenate(held["impacts"].to_list())
            ids = np.zeros(len(places), np.int64)
            ids[at] = np.concatenate(held["chunk_ids"].to_list())
            weigh = np.zeros((len(asked), len(row_of)))
            for i, (terms, values) in enumerate(zip(asked["terms"], asked["weights"], strict=True)):
                for t, w in zip(terms, values, strict=True):
                    if t in row_of:
                        weigh[i, row_of[t]] = w
            scores = np.round(weigh @ impacts, DIGITS)
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            values = np.take_along_axis(scores, order, 1)
            q, c = np.nonzero(values > 0)
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "chunk_id": ids[order[q, c]], "score": values[q, c]})

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(products, "query_id long, chunk_id long, score double")
