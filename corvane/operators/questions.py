"""Routing of a table of questions, and questions alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import routing
from corvane.sources.folders import stored

#: The least length of a title that counts (a fixed value).
TITLE = 4
#: What a strip of texts weighs (a text: its characters and as many more as ROW), texts of a tile, and columns of its matrices.
STRIP, ROW, TILE, WIDTH = 16 << 20, 1024, 2048, 2048


def title_hits(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """question_id, title_hits: how many of the different titles found for a question (question_id, title) stand in it.

    Titles of less than four characters don't count, nor do null ones; a question without titles has none.
    """
    found = titles.where(F.length("title") >= TITLE).select("question_id", "title").distinct()
    met = questions.select("question_id", "question").join(found, "question_id").where(F.expr("contains(question, title)"))
    counted = met.groupBy("question_id").agg(F.count(F.lit(1)).alias("title_hits"))
    return questions.select("question_id").join(counted, "question_id", "left").select("question_id", F.coalesce("title_hits", F.lit(0).cast("long")).alias("title_hits"))


def route_table(questions: DataFrame, titles: DataFrame, strict: bool = False) -> DataFrame:
    """question_id, mode, reason, demand, title_hits, final_mode, final_reason of ``questions`` (question_id, question), ids being unique and not null.

    First by the questions' own signals, then, for staged and multi-goal ones, by the titles found for them (question_id, title).
    """
    first = questions.select("question_id", routing.route(F.col("question")).alias("d"), routing.knowledge_demand(F.col("question")).alias("demand"))
    both = first.join(title_hits(questions, titles), "question_id").withColumn("final", routing.reroute(F.col("d"), F.col("title_hits"), strict))
    return both.select("question_id", "d.mode", "d.reason", "demand", "title_hits", F.col("final.mode").alias("final_mode"), F.col("final.reason").alias("final_reason"))


def similar_texts(texts: DataFrame, least: float) -> DataFrame:
    """a_text, b_text, similarity: unordered pairs of different ones of ``texts`` (text, its size, all distinct), the sets of whose character pairs agree to ``least`` or more (Jaccard).

    Exact, and by nature of the square of the texts: where there are a few hundred character pairs in all, each text meets each
    other in some of its rarest. So texts are dealt by the sizes of their sets into strips of bounded weight, and strips meet whose sizes
    allow ``least``: a group holds two strips, and a tile of one meets a tile of the other in a product of matrices. Only what reaches ``least`` leaves it.
    """
    weight = F.length("text") + ROW
    sizes = texts.groupBy("size").agg(F.sum(weight).alias("w"))
    sizes = sizes.select("size", "w", F.coalesce(F.sum("w").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a line for each size
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)
    dealt = stored(texts.join(sizes, "size").select("text", "size", F.floor((F.col("start") + F.col("w") * share) / STRIP).alias("strip")))
    strips = dealt.groupBy("strip").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    a, b = strips.toDF("a", "a_low", "a_high"), strips.toDF("b", "b_low", "b_high")
    met = a.join(b, (F.col("a") <= F.col("b")) & (F.col("b_low") * least <= F.col("a_high"))).select("a", "b")
    by_strip = met.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(batches, ignore_index=True)
        own = own.sort_values(["strip", "size"], ignore_index=True)
        row, gram = text_pairs(own["text"])
        known, column, often = np.unique(gram, return_inverse=True, return_counts=True)
        exact = len(known) <= WIDTH
        if not exact:  # the most frequent have columns of their own, others share some: products are bounds
            place = np.empty(len(known), np.int64)
            place[np.argsort(-often, kind="stable")] = np.arange(len(known))
            column = np.where(place < WIDTH // 2, place, WIDTH // 2 + place % (WIDTH // 2))[column]
        starts = np.searchsorted(row, np.arange(len(own) + 1))
        n, strip = np.diff(starts), own["strip"].to_numpy()
        edge = int(np.searchsorted(strip, strip[-1])) if strip[0] != strip[-1] else 0
        left = [(i, min(i + TILE, edge or len(own))) for i in range(0, edge or len(own), TILE)]
        right = [(i, min(i + TILE, len(own))) for i in range(edge, len(own), TILE)]

        def matrix(first: int, last: int) -> np.ndarray:
            of = slice(starts[first], starts[last])
            m = np.bincount((row[of] - first) * WIDTH + column[of], minlength=(last - first) * WIDTH)
            return m.reshape(last - first, WIDTH).astype(np.float32)

        for i, i_end in left:
            x = matrix(i, i_end)
            for j, j_end in right:
                if (not edge and j < i) or n[j] * least > n[i_end - 1] or n[i] * least > n[j_end - 1]:
                    continue
                common = x @ matrix(j, j_end).T
                p, q = np.nonzero(common >= np.float32(least * 0.9999 / (1 + least)) * (n[i:i_end, None] + n[None, j:j_end]).astype(np.float32))
                p, q, common = p + i, q + j, common[p, q].astype(np.int64)
                if not edge:
                    p, q, common = (v[p < q] for v in (p, q, common))
                if not exact:
                    common = np.array([len(np.intersect1d(gram[starts[s] : starts[s + 1]], gram[starts[t] : starts[t + 1]], assume_unique=True)) for s, t in zip(p, q, strict=True)], np.int64)
                value = common / np.maximum(1, n[p] + n[q] - common)
                kept = value >= least
                yield pd.DataFrame({"a_text": own["text"].to_numpy()[p[kept]], "b_text": own["text"].to_numpy()[q[kept]], "similarity": value[kept]})

    return dealt.join(by_strip, "strip").groupBy("a", "b").applyInPandas(alike, "a_text string, b_text string, similarity double")


def text_pairs(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair) of the distinct two-character substrings of texts of two characters and more, in this order; a pair is a number."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    every, row = np.concatenate(codes).astype(np.int64), np.repeat(np.arange(len(codes)), sizes)
    inside = row[1:] == row[:-1]
    row, pair = row[1:][inside], (every[:-1] << 21 | every[1:])[inside]
    order = np.lexsort((pair, row))
    row, pair = row[order], pair[order]
    first = np.append(True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))
    return row[first], pair[first]
