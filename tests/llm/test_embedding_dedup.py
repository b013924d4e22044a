import numpy as np

from corvane.llm.embedding_dedup import near_duplicates, passes_needed


def brute(rows, threshold=0.95):
    x = {}
    for n, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(np.float32(v), float)
            x[n] = a / np.linalg.norm(a)
    links = {n: [m for m in x if m != n and len(x[n]) == len(x[m]) and x[n] @ x[m] >= threshold] for n in x}
    root = {n: rows[n][0] for n in range(len(rows))}
    for _ in range(len(rows)):
        new = {n: min([root[n], *(root[m] for m in links.get(n, []))]) for n in root}
        if new == root:
            break
        root = new
    return sorted((rows[n][0], len(links.get(n, [])), root[n], root[n] == rows[n][0]) for n in root)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    dense = rng.standard_normal(16) + 0.03 * rng.standard_normal((260, 16))  # no window holds them all
    near = base[:40] + 0.05 * rng.standard_normal((40, 16))
    vectors = [*base, *dense, *near, *[base[3]] * 30, 4 * base[5], np.zeros(16), base[0][:8]]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 14), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, [])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, kept string")
    got = sorted(tuple(r) for r in near_duplicates(df, window=16, block=100).collect())
    assert got == brute(rows)


def test_empty_table_and_passes(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert passes_needed(10**9, 64, 0.95, 0.999) > passes_needed(10**5, 64, 0.95, 0.999) > 1


def test_isolated_pairs_among_concentrated_vectors(spark):
    rng = np.random.default_rng(5)
    lay = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = lay(3.0 * np.eye(64)[0] + lay(rng.standard_normal((5000, 64))))  # cosines about 0.9
    side = rng.standard_normal((500, 64))
    side = lay(side - (side * x[:500]).sum(1, keepdims=True) * x[:500])
    x = np.float32(np.concatenate([x, 0.955 * x[:500] + np.sqrt(1 - 0.955**2) * side]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = lay(x.astype(float))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.999 * near.sum()
    assert all(got[i] <= n for i, n in enumerate(near.sum(1)))
