import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import routing, text
from corvane.functions.embedding import hashed_embedding, string_hash
from corvane.plans.texts import QUESTIONS


def value(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column).collect()]


def test_token_estimates(spark):
    t = F.col("t")
    assert value(spark, text.lexical_tokens(t), "hello world", "日本語", "a_b-c1234, x²", "", None, "  ") == [4, 3, 3 + 1 + 1, 0, 0, 0]
    assert value(spark, text.packing_tokens(t), "abcd", "中文ab", "") == [1, 3, 1]
    assert value(spark, text.script_tokens(t), "かな漢字", " ", None, "abcde") == [4, 1, 1, 2]


def test_pairs_coverage_and_jaccard(spark):
    t = F.col("t")
    assert value(spark, text.grams(t), "A-b C", "x", "", "aaa") == [["ab", "bc"], ["x"], [], ["aa"]]
    assert value(spark, text.coverage(F.lit("abcd"), t), "xabx", None, "abcd") == [1 / 3, 0.0, 1.0]
    assert value(spark, text.coverage(F.lit("  "), t), "abc") == [0.0]


def test_trigrams_and_terms(spark):
    assert value(spark, text.trigrams(F.col("t")), "Cat")[0] == ["  c", " ca", "cat", "at "]
    assert value(spark, text.term_overlap(F.lit("red fox"), F.col("t")), "The Red dog", "") == [0.5, 0.0]


def test_marks(spark):
    assert value(spark, text.citations(F.col("t")), "[E2] x [E1][E2] [e3]") == [["E2", "E1"]]
    assert value(spark, text.abstains(F.col("t")), "We CANNOT\n determine", "fine", None, "资料不足。") == [True, False, False, True]
    assert value(spark, text.name_uuid(F.col("t")), "hello") == ["5d41402a-bc4b-3a76-b971-9d911017c592"]
    assert value(spark, text.document_references(F.col("t")), "《a》《b》《c") == [2]


def test_hash_and_embedding(spark):
    assert string_hash("hello") == 99162322 and string_hash("polygenelubricants") == -2147483648
    got = value(spark, hashed_embedding("t"), "ab", "", None)
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and sum(map(abs, got[1])) == 0 and len(got[2]) == 384


def test_router_knows_its_cases(spark):
    q = spark.createDataFrame(QUESTIONS, "id int, q string")
    got = {r.id: r.d for r in q.select("id", routing.route(F.col("q")).alias("d")).collect()}
    assert got[8].signals == ["MULTI_GOAL", "STAGED_TASK"] and got[6].mode == "FAST" and got[3].signals == ["MULTI_DOCUMENT", "COMPARISON"]
    assert value(spark, routing.route(F.col("t"))["reason"], None) == ["auto-deep-empty"]


def test_router_after_retrieval(spark):
    q = spark.createDataFrame([("分别说明",), ("第一阶段",), ("比较",)], "q string")
    for hits, strict, want in ((1, False, ["FAST", "DEEP", "DEEP"]), (1, True, ["DEEP", "DEEP", "DEEP"]), (2, True, ["FAST", "FAST", "DEEP"])):
        got = q.select(routing.reroute(routing.route(F.col("q")), F.lit(hits), strict)["mode"].alias("m")).collect()
        assert [r.m for r in got] == want


@pytest.mark.parametrize(("width", "strip"), [(2048, 16 << 20), (16, 20_000), (64, 1)])
def test_similar_texts_are_those_of_a_loop(spark, monkeypatch, width, strip):
    from corvane.operators import questions

    monkeypatch.setattr(questions, "WIDTH", width)
    monkeypatch.setattr(questions, "STRIP", strip)
    monkeypatch.setattr(questions, "TILE", 8)
    draw, texts = random.Random(5), {"ab", "aba", "漢字漢", "漢字漢字"}
    while len(texts) < (24 if strip == 1 else 80):
        t = "".join(draw.choice("abcde𝒳") for _ in range(draw.randint(2, 40)))
        texts |= {t, t[: len(t) // 2] + t[len(t) // 2 + 1 :] + "a" if draw.random() < 0.5 else t} - {""}
    texts = sorted(t for t in texts if len(t) > 1)
    grams = {t: {t[i : i + 2] for i in range(len(t) - 1)} for t in texts}
    df = spark.createDataFrame([(t, len(grams[t])) for t in texts], "text string, size int")
    got = sorted((*sorted((r.a_text, r.b_text)), round(r.similarity, 9)) for r in questions.similar_texts(df, 0.6).collect())
    want = [(a, b, round(v, 9)) for i, a in enumerate(texts) for b in texts[i + 1 :] if (v := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= 0.6]
    assert got == sorted(want) and want
