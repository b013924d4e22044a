import math
import random

import numpy as np

from corvane.llm.topk_search import best_of, exact_scores, top_k


def brute(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ok]
    out = []
    for n, (i, a) in enumerate(q):
        if i % every:
            continue
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), j) for m, (j, b) in enumerate(q) if m != n and len(a) == len(b))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(8)]) for i in range(300)]
    rows += [(0, rows[0][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, rows[5][1]), (350, [0.0] * 8), (400, [1.0] * 5), (450, [2.0] * 5), (500, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, score int, row int, dim int")
    got = [tuple(r) for r in top_k(df, tile=32, fan_in=4).collect()]
    assert sorted(got) == brute(rows, 5, 50)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_numbers_and_ties():
    big = np.array([[2.0**40, 1.0]])
    assert exact_scores(big, big)[0, 0] == 2**63 - 1
    r, c = best_of(np.array([[5, 7, 7, 5]]), np.array([9, 4, 2, 1]), np.array([[False, False, True, False]]), 3)
    assert r.tolist() == [0, 0, 0] and c.tolist() == [1, 3, 0]
