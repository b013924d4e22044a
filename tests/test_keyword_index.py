import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators.keyword_index import B, K1, KeywordIndex


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def scan(queries, chunks, k, scoring, mean):
    """The search by plain loops over all chunks."""
    df = Counter(w for c, t in chunks if c is not None for w in set(words(t)))
    n = sum(c is not None for c, _ in chunks)
    out = []
    for q, text in queries:
        asked = set(words(text))
        scores = []
        for c, t in chunks:
            own = Counter(words(t))
            if c is None or not asked & own.keys():
                continue
            if scoring == "share":
                value = len(asked & own.keys()) / len(asked)
            else:
                part = lambda w: own[w] * (K1 + 1) / (own[w] + K1 * (1 - B + B * sum(own.values()) / mean))
                value = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * part(w) for w in asked & own.keys())
            scores.append((-round(value, 9), c))
        out += [(q, c, r) for r, (_, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    chunks = [(i * 3, " ".join(r.choices(vocabulary, weight, k=r.randint(0, 25)))) for i in range(900)]
    chunks += [(5000, None), (5001, ""), (None, "w1 w2"), (6, "w250 w251 Ünïcode"), (6, "w250 w251 Ünïcode")]
    queries = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(25)] + [(100, None), (101, "nothing known"), (102, "ünïcode, W250!"), (103, "w0")]
    return chunks, queries


@pytest.mark.parametrize("scoring", ["share", "bm25"])
def test_as_a_scan(spark, corpus, scoring):
    chunks, queries = corpus
    index = KeywordIndex.build(spark.createDataFrame([(c, t, 1) for c, t in chunks], "chunk_id long, text string, block int"), scoring=scoring, block=16)
    again = KeywordIndex.open(spark, index.path)
    assert again == index
    got = again.search(spark.createDataFrame([(q, t, 2) for q, t in queries], "query_id long, text string, tile int"), 7, tile=5)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == scan(queries, chunks, 7, scoring, index.mean_length)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file:")) for f in names}


def test_appended_chunks_are_found_and_nothing_is_rewritten(spark, corpus):
    chunks, queries = corpus
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, text string")
    asked = frame(queries).withColumnRenamed("chunk_id", "query_id")
    first = KeywordIndex.build(frame(chunks[:600]), block=16)
    before = files(first.path)
    both = first.append(frame(chunks[600:]))
    after = files(both.path)
    assert before.items() <= after.items() and len(after) > len(before)
    rows = lambda index: sorted((r.query_id, r.chunk_id, r["rank"]) for r in index.search(asked, 7).collect())
    assert rows(both) == scan(queries, chunks, 7, "share", 1) == rows(KeywordIndex.open(spark, both.path))
    assert rows(first) == scan(queries, chunks[:600], 7, "share", 1)  # the older view still answers
    assert {r.term: r.df for r in both.statistics().collect()} == Counter(w for c, t in chunks if c is not None for w in set(words(t)))


def test_blocks_are_skipped(spark):
    lines = [(i, f"common {'alpha' if i % 40 == 7 else 'other'} filler{i}") for i in range(2000)]
    index = KeywordIndex.build(spark.createDataFrame(lines, "chunk_id long, text string"), block=16)
    hits, bounds, scored = index.trace(spark.createDataFrame([(1, "common alpha")], "query_id long, text string"), 10)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [7 + 40 * i for i in range(10)]
    assert bounds.count() == 125 and scored.count() <= 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "chunk_id long, text string")
    index = KeywordIndex.build(empty)
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert index.search(asked).count() == 0
    assert index.append(spark.createDataFrame([(4, "a b")], "chunk_id long, text string")).search(asked).count() == 1
    assert index.search(asked.limit(0)).count() == 0


def test_a_block_lies_in_one_file_and_spans_of_blocks_are_scored_whole(spark):
    rows = [(i, f"w{i % 7} common x{i}") for i in range(3000)]
    index = KeywordIndex.build(spark.createDataFrame(rows, "chunk_id long, text string"), block=4)
    files = index.table("postings").select("block", F.input_file_name().alias("file")).groupBy("block").agg(F.count_distinct("file").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
    asked = spark.createDataFrame([(1, "common w3 unknown"), (2, "w5"), (3, "none")], "query_id long, text string")
    weights = index.weights(asked)
    pairs = index.bounds(weights).select("query_id", "segment", "block")
    got = sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in index.score(pairs, weights, 4).collect())
    share = {i: len({"common", f"w{i % 7}"} & {"common", "w3"}) / 3 for i, _ in rows}
    assert got == sorted([(1, i, round(s, 6)) for i, s in share.items()] + [(2, i, 1.0) for i, _ in rows if i % 7 == 5])
