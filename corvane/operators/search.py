"""Keyword and vector search in batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import terms

#: What stands between words.
NO_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, n_terms) for each distinct term of each chunk: an inverted index to write once and read many times."""
    own = chunks.select("chunk_id", terms(F.col("text")).alias("t"))
    return own.select(F.explode("t").alias("term"), "chunk_id", F.size("t").alias("n_terms"))


def top_k(scored: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` of each query in an order, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    """The queries in blocks of about ``block``, each of which is searched by one pass over the chunks."""
    blocks = max(1, -(-queries.count() // block))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits, in order."""
    return [w for w in NO_WORD.split(text.lower()) if w]


def word_set(text: str) -> set[str]:
    return set(words_of(text))


def trigram_set(text: str) -> set[str]:
    """Trigrams of the words, each padded by two spaces before and one after."""
    return {p[i : i + 3] for p in (f"  {w} " for w in word_set(text)) for i in range(len(p) - 2)}


def best(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Of rows (query, chunk, score) the ``k`` first of each query, by score and then chunk."""
    order = np.lexsort((found["chunk"], -found["score"], found["query"]))
    query = found["query"][order]
    place = np.arange(len(order)) - np.searchsorted(query, query, "left")
    return {c: v[order[place < k]] for c, v in found.items()}


def tiled(chunks: DataFrame, queries: DataFrame, k: int, scorer: Callable[[list], Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]], columns: list[str], block: int, rows: int = 512) -> DataFrame:
    """Each query's ``k`` best chunks: query_id, chunk_id, score, rank; ties to the smaller chunk_id.

    Queries are taken in blocks of about ``block``; a block's rows (``query_id``
    and ``columns``, so of a bounded number) go to every task, which multiplies
    it with ``rows`` chunks at a time and carries its ``k`` best of each query
    along. Tasks' lists are merged at the end. ``scorer`` makes of a block's rows a
    function from chunks to scores (chunks by queries) and whether they count. Null ids take no part.
    """
    out = None
    queries, chunks = queries.where("query_id IS NOT NULL"), chunks.where("chunk_id IS NOT NULL")
    for part in query_blocks(queries, block):
        asked = part.select("query_id", *columns).collect()
        ids = np.array([r.query_id for r in asked], np.int64)

        def run(batches: Iterator[pa.RecordBatch], asked=asked, ids=ids) -> Iterator[pa.RecordBatch]:
            score = scorer(asked)
            held = {"query": ids[:0], "chunk": ids[:0], "score": np.zeros(0)}
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    piece = batch.slice(at, rows)
                    value, counts = score(piece)
                    own = piece.column(0).to_numpy()
                    # what can't enter a query's list by this piece alone goes at once
                    value = np.where(counts, value, -np.inf)
                    if len(own) > 2 * k:
                        counts = counts & (value >= np.partition(value, len(own) - k, axis=0)[len(own) - k])
                    r, c = np.nonzero(counts)
                    held = best({"query": np.r_[held["query"], ids[c]], "chunk": np.r_[held["chunk"], own[r]], "score": np.r_[held["score"], value[r, c]]}, k)
            yield pa.RecordBatch.from_arrays([pa.array(held["query"]), pa.array(held["chunk"]), pa.array(held["score"])], names=["query_id", "chunk_id", "score"])

        found = chunks.mapInArrow(run, "query_id long, chunk_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, [F.desc("score"), "chunk_id"])


def shared_features(asked: list, features: Callable[[str], set[str]]) -> tuple[np.ndarray, Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]:
    """How many features each query has, and a function from texts to how many they share with each query, and have."""
    sets = [features(r.text or "") for r in asked]
    number = {f: i for i, f in enumerate(sorted(set().union(*sets)))}
    weights = np.zeros((len(number), len(sets)), np.float32)
    for j, own in enumerate(sets):
        weights[[number[f] for f in own], j] = 1

    def shared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one, total = np.zeros((len(texts), len(number)), np.float32), np.zeros(len(texts))
        for i, t in enumerate(texts):
            own = features(t or "")
            total[i] = len(own)
            one[i, [number[f] for f in own if f in number]] = 1
        return np.rint(one @ weights).astype(np.float64), total

    return np.array([len(s) for s in sets], float), shared


def term_search(queries: DataFrame, chunks: DataFrame, k: int = 30, block: int = 1000) -> DataFrame:
    """Each query's ``k`` best chunks by the share of its terms that they hold: query_id, chunk_id, score, rank.

    ``queries``: query_id, text; ``chunks``: chunk_id, text (longs and strings). Only chunks that share a term count. Terms are
    met as tiles of query blocks and chunks (:func:`tiled`), so that a frequent
    term makes no pairs. Null texts share nothing.
    """

    def scorer(asked: list):
        sizes, shared = shared_features(asked, word_set)

        def score(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            common, _ = shared(piece.column(1).to_pylist())
            return common / np.maximum(sizes, 1), common > 0

        return score

    return tiled(chunks.select(F.col("chunk_id").cast("long"), "text"), queries, k, scorer, ["text"], block)


def trigram_search(queries: DataFrame, chunks: DataFrame, k: int = 30, least: float = 0.03, block: int = 1000) -> DataFrame:
    """Each query's ``k`` chunks of the greatest trigram Jaccard similarity above ``least``, as tiles of query blocks and chunks."""

    def scorer(asked: list):
        sizes, shared = shared_features(asked, trigram_set)

        def score(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            common, own = shared(piece.column(1).to_pylist())
            value = common / np.maximum(sizes[None, :] + own[:, None] - common, 1)
            return value, value > least

        return score

    return tiled(chunks.select(F.col("chunk_id").cast("long"), "text"), queries, k, scorer, ["text"], block)


def density_of(words: list[str], wanted: set[str]) -> float:
    """The sum over minimal covers of one over their length: spans of words with all wanted ones and no shorter span of that kind inside."""
    last: dict[str, int] = {}
    total, before = 0.0, -1
    for at, w in enumerate(words):
        if w in wanted:
            last[w] = at
            if len(last) == len(wanted):
                start = min(last.values())
                if start > before:  # of the covers with one start, the first to end is the shortest
                    total, before = total + 1.0 / (at - start + 1), start
    return total


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 30, least: float = 0.03, weight: float = 0.2, block: int = 1000) -> DataFrame:
    """Each query's ``k`` best chunks by cover density plus ``weight`` times the trigram similarity: query_id, chunk_id, score, rank.

    A chunk counts that holds all the query's words, or whose similarity is
    above ``least``. Density is looked for only where all words are.
    """

    def scorer(asked: list):
        n_grams, grams = shared_features(asked, trigram_set)
        n_words, held = shared_features(asked, word_set)
        wanted = [word_set(r.text or "") for r in asked]

        def score(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            texts = piece.column(1).to_pylist()
            common, own = grams(texts)
            similar = common / np.maximum(n_grams[None, :] + own[:, None] - common, 1)
            full = (held(texts)[0] == n_words) & (n_words > 0)
            dense = np.zeros(similar.shape)
            for r, c in zip(*np.nonzero(full), strict=True):
                dense[r, c] = density_of(words_of(texts[r]), wanted[c])
            return np.round(dense + weight * similar, 9), full | (similar > least)

        return score

    return tiled(chunks.select(F.col("chunk_id").cast("long"), "text"), queries, k, scorer, ["text"], block)


def web_query(text: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """A search box's query as alternatives of phrases that must all occur, and phrases that must not.

    Words are joined by AND, ``or`` splits alternatives, quotes make a phrase
    and a minus before a word or phrase excludes it.
    """
    import re

    groups, without, current = [], [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            groups, current = [*groups, current], []
            continue
        found = re.findall(r"[^\W_]+", phrase or word)
        if found:
            (without if minus else current).append(found)
    return [g for g in [*groups, current] if g], without


def matches_web_query(words: Column, query: str) -> Column:
    """Whether an ordered list of a text's words satisfies :func:`web_query`."""
    groups, without = web_query(query)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    holds = lambda phrase: joined.contains(f" {' '.join(phrase)} ")
    any_group = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for phrase in g:
            every = every & holds(phrase)
        any_group = any_group | every
    for phrase in without:
        any_group = any_group & ~holds(phrase)
    return any_group


def cover_density(chunks: DataFrame, query_terms: list[str]) -> DataFrame:
    """(chunk_id, density): the sum over minimal covers of one over their length.

    A cover is a span of word positions with all the query's terms and no
    shorter cover inside. Positions are compared in their own chunk only: for
    each place, the cover that ends there starts at the least of the terms'
    last places, and it is minimal if none that starts there ended before.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spots = chunks.select("chunk_id", F.posexplode(words).alias("at", "term")).where(F.col("term").isin(query_terms))
    w = Window.partitionBy("chunk_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"l{i}": F.max(F.when(F.col("term") == t, F.col("at"))).over(w) for i, t in enumerate(query_terms)}
    held = spots.withColumns(last)
    start = F.least(*[F.col(c) for c in last]) if len(last) > 1 else F.col("l0")
    full = held.where(~F.greatest(*[F.col(c).isNull().cast("int") for c in last], F.lit(0)).cast("boolean")).withColumn("start", start)
    # of the covers with one start, the first to end is the shortest
    shortest = full.groupBy("chunk_id", "start").agg(F.min("at").alias("at"))
    return shortest.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (F.col("at") - F.col("start") + 1)).alias("density"))


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column at length one (zero vectors stay), and which of them have ``width`` components."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), width))
    x[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1), good


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, within: list[str] | None = None, block: int = 1000) -> DataFrame:
    """Each query's ``k`` nearest vectors by cosine, exactly: query_id, vec_id, similarity, rank.

    ``queries``: query_id, embedding; ``vectors``: vec_id, embedding. A query's own id doesn't count, nor do null
    vectors, those of another length or those that hold null or non-finite components. ``within`` names columns that both sides hold
    and that must be equal (a knowledge base, say). Queries are taken in blocks
    and met with the vectors in tiles (:func:`tiled`): a tile is one matrix
    product. Similarities count to nine digits.
    """
    keys = within or []
    width = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    asked = queries.where((F.size("embedding") == width) & finite & F.col("query_id").isNotNull())
    own = vectors.where(F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>"), F.xxhash64(F.lit(0), *keys).alias("key"))
    asked = asked.select("query_id", F.col("embedding").cast("array<double>"), F.xxhash64(F.lit(0), *keys).alias("key"))

    def scorer(rows: list):
        q, _ = unit_rows(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), width)
        ids, keyed = np.array([r.query_id for r in rows], np.int64), np.array([r.key for r in rows], np.int64)

        def score(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x, good = unit_rows(piece.column(1), width)
            counts = good[:, None] & (piece.column(0).to_numpy()[:, None] != ids) & (piece.column(2).to_numpy()[:, None] == keyed)
            return np.round(x @ q.T, 9), counts

        return score

    out = tiled(own, asked, k, scorer, ["embedding", "key"], block)
    return out.select("query_id", F.col("chunk_id").alias("vec_id"), F.col("score").alias("similarity"), "rank")


def grep(chunks: DataFrame, pattern: str, title: Column, title_pattern: str | None = None, limit: int = 100) -> DataFrame:
    """Chunks whose title (score 1) or text (0.8) matches a pattern in any case, titles first, at most ``limit`` (100 at most)."""
    in_title = F.coalesce(title.rlike(f"(?i){title_pattern or pattern}"), F.lit(False))
    hit = chunks.where(in_title | F.col("text").rlike(f"(?i){pattern}")).withColumn("score", F.when(in_title, 1.0).otherwise(0.8))
    return hit.orderBy(F.desc("score"), "chunk_id").limit(min(limit, 100))


def with_fallback(strict: DataFrame, other: DataFrame) -> DataFrame:
    """The semantic hits, and for queries that have none the keyword hits."""
    return strict.unionByName(other.join(strict.select("query_id").distinct(), "query_id", "left_anti"))
