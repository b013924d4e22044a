import numpy as np
import pytest

from corvane.operators.search import tiled, vector_search
from corvane.operators.vector_index import VectorIndex, search_generations, spread_pivots

NAN, INF = float("nan"), float("inf")


def clustered(n, width, groups, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    return centres[r.integers(groups, size=n)] + 0.15 * r.normal(size=(n, width))


def scan(queries, vectors, k, keys=None):
    """The search by plain products; keys: (label of a query, labels of the vectors)."""
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    out = []
    for q, v in queries:
        if q is None or v is None or len(v) != 8 or any(x is None or not np.isfinite(x) for x in v) or not np.any(np.array(v, float)):
            continue
        unit = np.array(v, float) / np.linalg.norm(v)
        near = sorted((-round(float(unit @ (x / np.linalg.norm(x))), 9), i) for i, x in ok if i != q and (keys is None or i % keys == q % keys))
        out += [(q, i, rank) for rank, (_, i) in enumerate(near[:k], 1)]
    return sorted(out)


BAD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7), (9004, [NAN] + [1.0] * 7), (9005, [None] + [1.0] * 7), (9006, [INF] + [1.0] * 7), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def vectors():
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1500, 8, 20))]
    return rows + [(3, rows[3][1]), (7000, rows[3][1]), (7001, [2 * x for x in rows[3][1]])] + BAD


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, v, 5) for i, v in rows], f"{name} long, embedding array<double>, ring int")


def got(df):
    return sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())


def test_as_a_scan(spark, vectors):
    index = VectorIndex.build(frame(spark, vectors), 8, ring=32)
    assert VectorIndex.open(spark, index.path) == index and len(index.pivots) == 32
    queries = vectors[:1500:50] + BAD
    hits, pairs = index.trace(frame(spark, queries, "query_id"), 9, tile=7, group=10)
    assert got(hits) == scan(queries, vectors, 9)
    assert pairs.count() == pairs.distinct().count() <= 0.4 * 30 * 47  # of 47 rings a query


def test_within_a_column(spark, vectors):
    label = lambda df, c: df.withColumn("label", df[c] % 3)
    index = VectorIndex.build(label(frame(spark, vectors), "vec_id"), 8, within=["label"], ring=64)
    queries = vectors[:1500:90]
    assert got(index.search(label(frame(spark, queries, "query_id"), "query_id"), 5)) == scan(queries, vectors, 5, 3)


def test_own_id_strict_and_empty(spark, vectors):
    index = VectorIndex.build(frame(spark, vectors[:50]), 8)
    one = frame(spark, vectors[:1], "query_id")
    assert [r.vec_id for r in index.search(one, 1, own_id=True).collect()] == [0]
    with pytest.raises(ValueError):
        index.search(frame(spark, BAD[:1], "query_id"), 1, strict=True)
    assert index.search(frame(spark, BAD, "query_id"), 1).count() == 0
    none = VectorIndex.build(frame(spark, vectors[:1]).limit(0), 8)
    assert none.search(one, 1).count() == 0
    with pytest.raises(ValueError):
        none.search(one, 1, strict=True)
    with pytest.raises(ValueError):
        search_generations([])


def test_generations_are_merged(spark, vectors):
    clean = vectors[:400]
    halves = clean[:250], clean[150:]
    queries = clean[::40]
    asked = [(VectorIndex.build(frame(spark, half), 8), frame(spark, queries, "query_id")) for half in halves]
    assert got(search_generations(asked, 6)) == scan(queries, clean, 6)
    allowed = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "vec_id long")
    assert got(search_generations(asked, 3, over_fetch=200, allowed=allowed)) == scan(queries, [x for x in clean if x[0] % 2 == 0], 3)


def test_pivots_lie_apart():
    points = clustered(300, 8, 6)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    chosen = spread_pivots(unit, 6)
    assert len(chosen) == 6 and min(np.linalg.norm(a - b) for i, a in enumerate(chosen) for b in chosen[:i]) > 0.3
    assert len(spread_pivots(np.ones((5, 2)), 4)) == 1


def test_scanning_search_leaves_out_what_isnt_a_vector(spark, vectors):
    queries = vectors[:1500:150] + BAD
    assert got(vector_search(frame(spark, queries, "query_id"), frame(spark, [x for x in vectors if x[0] != 9002]), 4)) == scan([q for q in queries if q[0] != 9002], vectors, 4) + sorted(
        (9002, i, r) for r, i in enumerate(sorted(i for i, v in vectors if i is not None and i not in (9001, 9002, 9003, 9004, 9005, 9006))[:4], 1)
    )


def test_tiles_stand_null_ids(spark):
    import pyarrow as pa

    def scorer(asked):
        def score(piece: pa.RecordBatch):
            return np.ones((piece.num_rows, len(asked))), np.ones((piece.num_rows, len(asked)), bool)

        return score

    chunks = spark.createDataFrame([(1, "a"), (None, "b")], "chunk_id long, text string")
    queries = spark.createDataFrame([(5, "x"), (None, "y")], "query_id long, text string")
    assert [(r.query_id, r.chunk_id) for r in tiled(chunks, queries, 3, scorer, ["text"], 10).collect()] == [(5, 1)]
