import pytest
from pyspark.sql import functions as F

from corvane.operators import fusion, packing, ranking, search

HITS = "query_id long, list_idx int, rank int, chunk_id long, score double"


def test_fast_fusion_counts_repeats_and_keeps_first_seen(spark):
    hits = spark.createDataFrame([(1, 0, 1, 10, 0.9), (1, 0, 2, 11, 0.8), (1, 1, 1, 11, 0.7), (1, 1, 2, 10, 0.6), (1, 1, 3, 10, 0.6)], HITS)
    got = [(r.chunk_id, r.rrf_rank) for r in fusion.fuse_fast(hits).orderBy("rrf_rank").collect()]
    assert got == [(10, 1), (11, 2)]
    tie = hits.where("rank < 3")
    assert [r.chunk_id for r in fusion.fuse_fast(tie).orderBy("rrf_rank").collect()] == [10, 11]


def test_deep_fusion_advances_on_new_chunks(spark):
    hits = spark.createDataFrame([(1, 0, 1, 10, 0.9), (1, 0, 2, 10, 0.8), (1, 0, 3, 11, 0.95), (1, 1, 1, 11, 0.2)], HITS)
    got = {r.chunk_id: r for r in fusion.fuse_deep(hits).collect()}
    assert got[11].rrf == pytest.approx(1 / 62 + 1 / 61) and got[11].best_score == 0.95 and got[10].routes == [0]


def test_routes_are_protected(spark):
    ranked = spark.createDataFrame([(1, c, c, [0] if c < 5 else [1]) for c in range(1, 7)], "query_id long, chunk_id long, rank int, routes array<int>")
    assert [r.chunk_id for r in fusion.protect_routes(ranked, 3).orderBy("final_rank").collect()] == [1, 5, 2]


def test_parents(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 100, "a"), (1, 2, 2, 100, "b"), (1, 3, 3, None, "c"), (1, 4, 4, 200, "d")], "query_id long, chunk_id long, rank int, parent_id long, text string")
    assert [r.parent_id for r in fusion.select_parents(ranked, 5).orderBy("parent_rank").collect()] == [100, 200]
    parents = spark.createDataFrame([(100, "whole a b")], "chunk_id long, text string")
    assert [r.text for r in fusion.expand_parents(ranked, parents).orderBy("group_rank").collect()] == ["whole a b", "c", "d"]


def candidates(rows):
    """(goal, order, chunk, doc, rrf rank, rerank rank)"""
    return [(1, g, o, "P", c, d, rr, None if rr is None else 1 / rr, kk, None if kk is None else 1 / kk) for g, o, c, d, rr, kk in rows]


SCHEMA = "run_id long, goal_id long, goal_order int, phase string, chunk_id long, document_id long, rrf_rank int, rrf_score double, rerank_rank int, rerank_score double"
EVIDENCE = "run_id long, goal_id long, document_id long, requirement_id long, active boolean"


def balanced(spark, rows, evidence=()):
    fused = ranking.fuse_phases(spark.createDataFrame(candidates(rows), SCHEMA), spark.createDataFrame(list(evidence), EVIDENCE))
    return [r.document_id for r in ranking.balance_goals(fused).orderBy("position").collect()]


def test_goals_take_turns(spark):
    assert balanced(spark, [(1, 1, 1, 11, 1, None), (1, 1, 2, 12, 2, None), (2, 2, 3, 13, 1, None), (3, 3, 4, 14, 1, None)]) == [11, 13, 14, 12]


def test_a_shared_document_counts_once(spark):
    assert balanced(spark, [(1, 1, 1, 50, 1, None), (1, 1, 2, 51, 2, None), (2, 2, 3, 50, 1, None), (2, 2, 4, 52, 2, None)]) == [50, 52, 51]


def test_ranks_are_normalised_and_evidence_promotes(spark):
    assert balanced(spark, [(1, 1, 1, 11, 50, 8), (1, 1, 2, 12, 1, 9)]) == [12, 11]
    assert balanced(spark, [(1, 1, 1, 11, 1, 1), (1, 1, 2, 12, 40, 11)], [(1, 1, 12, 5, True)]) == [12, 11]


def test_packs_in_order(spark):
    long = "x" * 4000
    rows = [(1, 1, 1, "aaaa bbbb"), (1, 2, 2, "AAAA  bbbb"), (1, 3, 3, " "), (1, 4, 4, "c" * 400), (1, 5, 5, "dddd"), (1, 6, 1, "zzzz"), (2, 1, 9, long)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, text string")
    got = [(r.query_id, r.evidence, r.chunk_id, r.tokens) for r in packing.pack_in_order(hits, 50).orderBy("query_id", "evidence").collect()]
    assert got == [(1, 1, 1, 3), (1, 2, 5, 1), (2, 1, 9, 100)]


def test_packs_for_coverage(spark):
    rows = [(1, 1, 1, 10, 0.9, 50), (1, 1, 1, 11, 0.8, 50), (1, 2, 1, 12, 0.1, 50), (1, 1, 2, 12, 0.1, 50), (2, 1, 1, 20, 0.5, 999), (2, 1, 1, 21, 0.4, 500)]
    e = spark.createDataFrame(rows, "run_id long, goal_id long, requirement_id long, parent_id long, score double, tokens long")
    got = [(r.run_id, r.position, r.parent_id) for r in packing.pack_for_coverage(e, 100).orderBy("run_id", "position").collect()]
    assert got == [(1, 1, 12), (1, 2, 10), (2, 1, 21)]


def test_quotas(spark):
    rows = [(1, s, 1, s % 4, 7, "P") for s in range(8)] + [(1, 9, 2, 0, 7, "P")]
    a = spark.createDataFrame(rows, "run_id long, seq long, goal_id long, span_id long, parent_id long, phase string")
    got = [r.decision for r in packing.accept_within_quotas(a, 3, 3, 2).orderBy("seq").collect()]
    assert got == ["ACCEPTED", "ACCEPTED", "QUOTA", "QUOTA", "REPEAT", "REPEAT", "QUOTA", "QUOTA", "ACCEPTED"]


def test_links_to_saturated_requirements_are_trimmed(spark):
    rows = [(1, 0, 1, 10, 7, "P", [1, 2]), (1, 1, 1, 11, 7, "P", [1]), (1, 2, 1, 12, 8, "P", [1, 2]), (1, 3, 1, 13, 8, "P", [1]), (1, 4, 1, 12, 8, "P", [2]), (1, 5, 1, 11, 7, "P", [3]), (1, 6, 1, 14, 9, "P", None), (2, 0, 1, 10, 7, "P", [1])]
    a = spark.createDataFrame(rows, "run_id long, seq long, goal_id long, span_id long, parent_id long, phase string, requirements array<long>")
    got = [(r.decision, r.linked) for r in packing.accept_within_quotas(a, 9, 9, 9, 2).orderBy("run_id", "seq").collect()]
    # at 5, requirement 1 has its two spans, so what 11 held of it is trimmed as 3 joins
    assert got == [("ACCEPTED", [1, 2]), ("ACCEPTED", [1]), ("ACCEPTED", [2]), ("QUOTA", None), ("REPEAT", [2]), ("MERGED", [3]), ("QUOTA", None), ("ACCEPTED", [1])]


def test_search_box_queries(spark):
    rows = [("mit license text",), ("the apache license",), ("apache foo license",), ("mit license gnu",)]
    words = F.split("t", " ")
    got = spark.createDataFrame(rows, "t string").where(search.matches_web_query(words, 'license mit or "apache license" -gnu')).collect()
    assert [r.t for r in got] == ["mit license text", "the apache license"]


def test_cover_density(spark):
    c = spark.createDataFrame([(1, "a x b a"), (2, "a a"), (3, "b a")], "chunk_id long, text string")
    got = {r.chunk_id: r.density for r in search.cover_density(c, ["a", "b"]).collect()}
    assert got == {1: pytest.approx(1 / 3 + 1 / 2), 3: pytest.approx(1 / 2)}


def test_keyword_search_by_brute_force(spark):
    import random
    import re

    rng = random.Random(6)
    words = ["apple", "Birne", "été", "a1", "x", "of"]
    chunks = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) + rng.choice(["", ".", " - "])) for i in range(300)] + [(400, None)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(12)] + [(50, ""), (51, None)]

    def grams(t):
        return {p[i : i + 3] for p in (f"  {w} " for w in re.findall(r"[^\W_]+", (t or "").lower())) for i in range(len(p) - 2)}

    def density(t, q):
        own, want = re.findall(r"[^\W_]+", (t or "").lower()), set(re.findall(r"[^\W_]+", (q or "").lower()))
        spans = {(i, j) for i in range(len(own)) for j in range(i, len(own)) if want <= set(own[i : j + 1])} if want else set()
        least = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
        return sum(1 / (j - i + 1) for i, j in least), bool(spans)

    want = set()
    for q, query in asked:
        scored = []
        for c, t in chunks:
            a, b = grams(query), grams(t)
            similar = len(a & b) / len(a | b) if a | b else 0
            dense, whole = density(t, query)
            if whole or similar > 0.03:
                scored.append((-round(dense + 0.2 * similar, 9), c))
        want |= {(q, c, round(-s, 6), n + 1) for n, (s, c) in enumerate(sorted(scored)[:7])}
    c = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, text string")
    for block in (1000, 4):
        got = {(r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in search.keyword_search(q, c, 7, block=block).collect()}
        assert got == want


def test_vectors_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    rows = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert rows(search.vector_search(q, v, 3, block=2)) == rows(search.vector_search(q, v, 3))


def test_diversity(spark):
    rows = [("g", 1, "A", ["ab", "bc"], 2, 0.9), ("g", 2, "A", ["xy"], 2, 0.8), ("g", 3, "B", ["ab", "bc"], 2, 0.7), ("g", 4, "B", ["pq"], 1, 0.1)]
    c = spark.createDataFrame(rows, "group_id string, item_id long, kind string, pairs array<string>, documents int, quality double")
    assert [r.item_id for r in packing.diversify(c, 3).orderBy("position").collect()] == [1, 4, 2]


def test_one_organization_keeps_all_tasks_busy(spark):
    from pyspark.sql import functions as F

    from corvane.operators import scope

    users = spark.createDataFrame([(i, "o", "VIEWER", i != 3) for i in range(40)] + [(99, None, "ADMIN", True)], "user_id long, org string, role string, enabled boolean")
    docs = spark.createDataFrame([(i, "o" if i else None, "RESTRICTED", [i % 40], ["EDITOR"]) for i in range(300)], "document_id long, org string, access_mode string, allowed_users array<long>, allowed_roles array<string>")
    got = scope.document_access(users, docs).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.user_id, r.document_id, r.reason) for r in got) == sorted((u, d, "USER" if d % 40 == u else "DENIED") for u in range(40) if u != 3 for d in range(1, 300))
    assert len({r.task for r in got}) == 4
