from pyspark.sql import functions as F

from corvane.operators import evidence


def test_balanced_pick_is_the_greedy_one(spark):
    import random

    rng = random.Random(4)
    for wide in (1, 3):
        rows = [(g, i, rng.choice(["a", "b", None]), sorted(rng.sample("uvwxyz", rng.randint(1, wide))), rng.randint(0, 9)) for g in "pq" for i in range(40)]
        got = evidence.balanced_pick(spark.createDataFrame(rows, "group_id string, item_id long, kind string, documents array<string>, rank int"), 9)
        want = []
        for g in "pq":
            rest, kinds, docs = [r for r in rows if r[0] == g], {}, {}
            for n in range(9):
                best = min(rest, key=lambda r: (kinds.get(r[2], 0), sum(docs.get(d, 0) for d in r[3]), r[4], r[1]))
                rest.remove(best)
                kinds[best[2]] = kinds.get(best[2], 0) + 1
                for d in best[3]:
                    docs[d] = docs.get(d, 0) + 1
                want.append((g, n + 1, best[1]))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_a_scorer_that_fails_leaves_the_fused_order(spark):
    rows = [(1, 10, 1, 0.1), (1, 11, 2, 0.9), (2, 10, 1, None), (2, 11, 2, 0.9)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, s double")
    got = {(r.query_id, r.chunk_id): (r.final_rank, r.score, r.reranked) for r in evidence.rerank(df, F.col("s"), 2).collect()}
    assert got == {(1, 11): (1, 0.9, True), (1, 10): (2, 0.1, True), (2, 10): (1, None, False), (2, 11): (2, None, False)}


def test_anchors_stand_once_in_their_parent(spark):
    children = spark.createDataFrame([(1, 10, 5, 0.5, "bc"), (1, 11, 5, 0.7, "aa"), (1, 12, 5, 0.6, "zz"), (1, 13, 6, 0.9, "x"), (1, 14, None, 1.0, "a")], "query_id long, chunk_id long, parent_id long, score double, text string")
    parents = spark.createDataFrame([(5, "aaabc")], "parent_id long, text string")
    blocks = spark.createDataFrame([(5, 1, None, None), (5, 2, 4, "h"), (5, 3, 3, "i")], "parent_id long, ord int, page int, heading string")
    [r] = evidence.load_parents(children, parents, blocks, 2).collect()
    assert (r.parent_rank, r.score, r.first_page, r.last_page, r.heading) == (2, 0.7, 3, 4, "h")
    assert [tuple(a) for a in r.anchors] == [(10, 3, 5)] and [p.chunk_id for p in r.provenance] == [11, 12, 10]
    assert evidence.load_parents(children, parents, blocks, 1).count() == 0


def test_a_judgement_that_leaves_a_requirement_out_is_degraded(spark):
    key = "run_id long, goal_id long, requirement_id long"
    asked = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)], key)
    decided = spark.createDataFrame([(1, 1, 1, "COVERED"), (2, 1, 1, "COVERED"), (3, 1, 1, "MISSING"), (4, 1, 1, "COVERED"), (4, 1, 2, "MISSING")], key + ", status string")
    cited = spark.createDataFrame([(1, 1, 1, 7), (2, 1, 1, 7), (4, 1, 1, 7)], key + ", evidence_id long")
    done = spark.createDataFrame([(3,)], "run_id long")
    got = {(r.run_id, r.goal_id): (r.missing, r.degraded, r.state) for r in evidence.coverage(asked, decided, cited, cited, done).collect()}
    assert got == {(1, 1): (1, True, "NEEDS_REPAIR"), (1, 2): (1, True, "NEEDS_REPAIR"), (2, 1): (0, False, "SATISFIED_LOCKED"), (3, 1): (1, False, "REPAIR_EXHAUSTED"), (4, 1): (1, True, "NEEDS_REPAIR")}
