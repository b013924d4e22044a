import random
import re

import numpy as np

from corvane.llm.graph import components
from corvane.llm.ngram_join import common_values, estimated_recall, met, near_duplicates, plausible_links, shortest_prefix, without_near_duplicates


def sets_of(text, size=5):
    w = re.findall(r"\w+", (text or "").lower())
    return tuple(w), ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}) if w else set()


def brute(rows, threshold=0.8):
    x = [sets_of(t) for _, t in rows]
    links = [[m for m in range(len(rows)) if m != n and x[n][1] and len(x[n][1] & x[m][1]) >= threshold * len(x[n][1] | x[m][1]) - 1e-9] for n in range(len(rows))]
    root = [i for i, _ in rows]
    for _ in rows:
        root = [min([root[n], *(root[m] for m in links[n])]) for n in range(len(rows))]
    classes = {}
    for (i, _), (w, _) in zip(rows, x):
        if w:
            classes[w] = min(classes.get(w, i), i)
    return sorted((i, classes.get(w, i), len(links[n]), root[n], root[n] == i) for n, ((i, _), (w, _)) in enumerate(zip(rows, x)))


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(3, 300)) for _ in range(120)]
    near = []
    for b in base[:60]:
        c = list(b)
        for _ in range(max(1, len(c) // rng.choice([20, 60, 200]))):
            c[rng.randrange(len(c))] = rng.choice(words)
        near.append(c)
    hot = [list(base[-1]) for _ in range(150)]
    for i, h in enumerate(hot):
        h[i % len(h)] = f"z{i}"
    passage = rng.choices(words, k=60)
    shared = [rng.choices(words, k=50) + passage + rng.choices(words, k=30) for _ in range(60)]
    texts = [" ".join(x) for x in [*base, *near, *hot, *shared]]
    texts += [texts[5].upper() + "!"] * 40 + ["", "...", "one", "One.", "a b c d", "É_1 été Été x y z"]
    rows = list(enumerate(texts)) + [(9000, None), (9001, "long " + "lorem ipsum dolor sit amet " * 20_000)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_links int")
    want = brute(rows)
    for block in (512, 40):
        assert sorted(tuple(r) for r in near_duplicates(df, block=block).collect()) == want
    kept = sorted(r.doc_id for r in without_near_duplicates(df).collect())
    assert kept == [w[0] for w in want if w[4]]


def test_rows_that_share_an_id_nulls_and_empty(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words in this one text"), (None, "q r s t u v"), (None, "q r s t u v"), (2, "Q R S T U V")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.kept) for r in got) == [(0, 2, False), (0, 2, False), (1, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    kept = without_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(1, "a"), (1, "o"), (2, "Q")]
    alone = without_near_duplicates(df.where("doc_id IS NULL OR doc_id = 1")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in alone) == [(0, "q"), (1, "a"), (1, "o")]
    assert near_duplicates(df.limit(0)).count() == 0 and without_near_duplicates(df.limit(0)).count() == 0


def test_texts_that_share_an_id_are_apart(spark):
    rows = [(1, "near the text of another row a b c d e f g"), (5, "near the text of another row a b c d e f g"), (5, "unique and clean words one two three"), (9, "unique and clean words one two three"), (7, ""), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 5, False)]
    assert sorted((r.doc_id, (r.text or "-")[:1]) for r in without_near_duplicates(df).collect()) == [(1, "n"), (5, "u"), (7, "-"), (8, "-")]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 7), (3, "g h i j k l", 7)], "doc_id long, text string, id long")
    for c in ("x", "h1", "h2", "rep", "cid", "kept_id_", "again_", "n", "component", "stays", "first", "k0", "i_", "own"):
        df = df.withColumn(c, df["id"])
    got = without_near_duplicates(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert near_duplicates(df).where("kept").count() == 2


def test_levels_shorten_with_the_recall_asked_for():
    depths = [shortest_prefix(0.8, 16, 8, r) for r in (0.9, 0.98, 0.999, 0.9999)]
    assert depths == sorted(depths, reverse=True) and depths[0] == 8 and depths[-1] < 5
    none = np.zeros(97, int)
    assert abs(estimated_recall(none, 6, 16, 0.8) - met(0.8, 6, 16)) < 1e-12  # nothing found: what a pair at the threshold would be
    easy, hard = none.copy(), none.copy()
    easy[80], hard[77] = 10_000, 10_000
    assert estimated_recall(hard, 6, 16, 0.8) < estimated_recall(easy, 6, 16, 0.8) and estimated_recall(easy, 6, 16, 0.8) > estimated_recall(none, 6, 16, 0.8)


def borderline(rng, n):
    """Pairs with a similarity just above 0.8: all but a tail of a text's words."""
    rows = []
    for i in range(n):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(150, 400))]
        shingle_count = len(words) - 4
        shared = int(shingle_count * rng.uniform(0.895, 0.91)) + 4  # shared / (2n - shared) from 0.81
        other = words[:shared] + [f"u{rng.randrange(10**6)}" for _ in range(len(words) - shared)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


def test_recall_just_above_the_threshold(spark):
    df = spark.createDataFrame(borderline(random.Random(8), 1500), "doc_id long, text string")
    got = near_duplicates(df).where("n_links > 0").count()
    assert got >= 0.998 * 3000


def test_the_data_decide_how_far_prefixes_are_shortened(spark):
    """Few pairs near the threshold: shortened to the floor; a table of many easier ones stops earlier."""
    rng = random.Random(9)

    def levels(lo, hi, n):
        rows = []
        for i in range(n):
            words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
            shared = int(296 * rng.uniform(lo, hi)) + 4
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:shared] + [f"u{rng.randrange(10**6)}" for _ in range(300 - shared)]))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        from pyspark.sql import functions as F

        from corvane.llm.ngram_join import signed

        signs = signed(df.select("doc_id", F.col("text").alias("t"), F.xxhash64("text").alias("x")), 5, 96, 17)
        return plausible_links(signs.select(F.col("doc_id").alias("cid"), "sig"), 0.8, 16, 6, 0.995, 0.5, 256)[1]

    few, many = levels(0.99, 0.999, 5), levels(0.915, 0.93, 400)
    assert few[-1][0] < many[-1][0] and few[-1][1] >= 0.995 and many[-1][1] >= 0.995


def test_common_values():
    a, b, c = (np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3], [9]))
    assert common_values([a, b, c]).tolist() == [[3, 2, 0], [2, 2, 0], [0, 0, 1]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(300, 340)] + [(7, 7), (2, 339)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[j] for j in [2, 5, *range(300, 340)]} == {2} and got[7] == 7


def test_tables_of_less_words_than_a_shingle(spark):
    for texts in (["Ja"], ["Ja", "ja"], ["", None, "one two"]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: (r.n_links, r.kept) for r in near_duplicates(df).collect()}
        assert len(got) == len(texts) and sum(k for _, k in got.values()) == (1 if texts == ["Ja", "ja"] else len(texts))
