import pytest

from corvane.operators import metrics


def test_one_case(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, 12, 4), (2, 20, 1)], "case_id long, document_id long, rank int")
    expected = spark.createDataFrame([(1, 11), (1, 99), (2, 20)], "case_id long, document_id long")
    forbidden = spark.createDataFrame([(1, 12)], "case_id long, document_id long")
    got = {r.case_id: r for r in metrics.case_metrics(cases, ranked, expected, forbidden).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.recall5, a.precision5, a.mrr5, a.hit5, a.forbidden_hits) == (0.5, pytest.approx(1 / 3), 0.5, 1, 1)
    assert a.ndcg5 == pytest.approx((1 / 1.5849625007) / (1 + 1 / 1.5849625007)) and a.map5 == pytest.approx(0.25)
    assert (b.recall5, b.ndcg10, b.map10, b.precision10) == (1.0, 1.0, 1.0, 1.0)
    assert (c.recall5, c.ndcg5, c.mrr10, c.hit10, c.n_expected) == (0.0, 0.0, 0.0, 0, 0)
    total = metrics.aggregate_metrics(metrics.case_metrics(cases, ranked, expected)).first()
    assert (total.n_cases, total.n_graded, total.recall5, total.precision5) == (3, 2, 0.75, pytest.approx(0.444444))


def test_routing(spark):
    rows = [("FAST", "FAST", "LLM", False), ("DEEP", "DEEP", "LLM", False), ("DEEP", "FAST", "LLM", True), ("DEEP", "DEEP", "LLM", False), (None, "FAST", "LLM", False)]
    got = metrics.routing_metrics(spark.createDataFrame(rows, "expected_mode string, selected_mode string, source string, fallback boolean")).first()
    assert (got.accuracy, got.fast_recall, got.deep_recall, got.fast_precision, got.deep_precision) == (0.75, 1.0, 0.666667, 0.5, 1.0)
    assert (got.deep_to_fast, got.fallbacks, got.fallback_rate) == (1, 1, 0.2)


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 21)], "x int")
    assert tuple(df.agg(*metrics.nearest_rank("x", 0.5, 0.95, 0.99)).first()) == (10, 19, 20)
