"""Retrieval quality, routing and latency metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_documents(candidates: DataFrame, depth: int = 10) -> DataFrame:
    """Each case's documents at their first place among the candidates: case_id, document_id, place (from 1)."""
    first = candidates.groupBy("case_id", "document_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("case_id").orderBy("rank", "document_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth)


def case_metrics(cases: DataFrame, candidates: DataFrame, expected: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """A line for each case: recall, precision, reciprocal rank, nDCG, average precision and hits at 5 and 10.

    ``expected`` and ``forbidden`` hold (case_id, document_id). Precision
    divides by the length of the list, and the ideal gain is no longer than the
    list: short lists aren't penalised. Without expected documents all are 0.
    """
    docs = ranked_documents(candidates)
    marked = docs.join(expected.distinct().withColumn("relevant", F.lit(1)), ["case_id", "document_id"], "left").fillna(0, ["relevant"])
    w = Window.partitionBy("case_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("found", F.sum("relevant").over(w))
    gain = F.lit(1.0) / F.log2(F.col("place") + F.lit(1.0))
    at = lambda k: F.when((F.col("place") <= k) & (F.col("relevant") == 1), F.lit(1))
    aggs = [F.min(F.when(F.col("relevant") == 1, F.col("place"))).alias("first")]
    for k in (5, 10):
        aggs += [
            F.coalesce(F.sum(at(k)), F.lit(0)).alias(f"matched{k}"),
            F.count_if(F.col("place") <= k).alias(f"length{k}"),
            F.coalesce(F.sum(at(k) * gain), F.lit(0.0)).alias(f"dcg{k}"),
            F.coalesce(F.sum(at(k) * F.col("found") / F.col("place")), F.lit(0.0)).alias(f"precisions{k}"),
        ]
    sums = marked.groupBy("case_id").agg(*aggs)
    wanted = expected.distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected"))
    out = cases.select("case_id").join(wanted, "case_id", "left").join(sums, "case_id", "left").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, first = F.col("n_expected"), F.col("first")
    columns = [F.col("case_id"), n.alias("n_expected"), ratio(F.lit(1.0), first).alias("mrr10"), F.when(first.between(1, 5), 1.0 / first).otherwise(F.lit(0.0)).alias("mrr5")]
    for k in (5, 10):
        ideal = F.least(F.col(f"length{k}"), F.least(F.lit(k), n))
        idcg = F.aggregate(F.when(ideal > 0, F.sequence(F.lit(1).cast("long"), ideal.cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
        columns += [
            ratio(F.col(f"matched{k}"), n).alias(f"recall{k}"),
            ratio(F.col(f"matched{k}"), F.col(f"length{k}")).alias(f"precision{k}"),
            ratio(F.col(f"dcg{k}"), idcg).alias(f"ndcg{k}"),
            ratio(F.col(f"precisions{k}"), F.least(F.lit(k), n)).alias(f"map{k}"),
            first.between(1, k).cast("int").alias(f"hit{k}"),
        ]
    out = out.select(*columns)
    if forbidden is not None:
        hits = docs.join(forbidden.distinct(), ["case_id", "document_id"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("forbidden_hits"))
        out = out.join(hits, "case_id", "left").fillna(0, ["forbidden_hits"])
    return out


def mean(x: Column | str) -> Column:
    """The mean, 0 of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def aggregate_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over cases: recall, reciprocal rank and hits over those with expected documents, the others over all."""
    graded = F.col("n_expected") > 0
    some = lambda c: F.round(mean(F.when(graded, F.col(c))), 6).alias(c)
    every = lambda c: F.round(mean(c), 6).alias(c)
    aggs = [F.count(F.lit(1)).alias("n_cases"), F.count_if(graded).alias("n_graded"), *[some(c) for c in ("recall5", "recall10", "mrr5", "hit5", "hit10")], *[every(c) for c in ("precision5", "precision10", "ndcg5", "ndcg10", "map5", "map10")]]
    return cases.groupBy(*(by or [])).agg(*aggs)


def nearest_rank(x: str, *shares: float) -> list[Column]:
    """Nearest-rank percentiles of a column: p50, p95, ..."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})").alias(f"p{round(100 * p)}") for p in shares]


def routing_metrics(rows: DataFrame) -> DataFrame:
    """One line of routing counts and ratios over (expected_mode, selected_mode, source, fallback); an empty denominator gives 0."""
    e, s = F.col("expected_mode"), F.col("selected_mode")
    graded = e.isin("FAST", "DEEP")
    both = lambda m: F.count_if((e == m) & (s == m))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    hits = lambda cond: F.count_if(cond & graded)
    cells = [F.count_if((e == a) & (s == b)).alias(f"{a.lower()}_to_{b.lower()}") for a in ("FAST", "DEEP") for b in ("FAST", "DEEP", "ERROR")]
    return rows.agg(
        hits(F.lit(True)).alias("graded"),
        hits(e == s).alias("correct"),
        ratio(hits(e == s), hits(F.lit(True))).alias("accuracy"),
        ratio(both("FAST"), F.count_if(e == "FAST")).alias("fast_recall"),
        ratio(both("DEEP"), F.count_if(e == "DEEP")).alias("deep_recall"),
        ratio(both("FAST"), hits(s == "FAST")).alias("fast_precision"),
        ratio(both("DEEP"), hits(s == "DEEP")).alias("deep_precision"),
        F.count_if("fallback").alias("fallbacks"),
        ratio(F.count_if("fallback"), F.count(F.lit(1))).alias("fallback_rate"),
        *cells,
    )


def strict_measures(expected: Column, found: Column, read: Column) -> dict[str, Column]:
    """Recall of expected documents in what a run found and read, as arrays in order.

    ``all_recall``, ``discovery5`` and ``discovery10`` (over all found, the first
    five, the first ten) are null where nothing was reported (null ``found``);
    ``deep_read`` and ``compliant`` (1.0 if anything was read) where ``read`` is null.
    Without expected documents recall is 0; one that is named twice counts twice.
    """
    want = F.filter(F.coalesce(expected, F.array()), lambda d: d.isNotNull())

    def recall(have: Column) -> Column:
        share = F.size(F.filter(want, lambda d: F.array_contains(have, d))) / F.size(want)
        return F.when(have.isNotNull(), F.when(F.size(want) == 0, F.lit(0.0)).otherwise(share))

    return {
        "all_recall": recall(found), "discovery5": recall(F.slice(found, 1, 5)), "discovery10": recall(F.slice(found, 1, 10)),
        "deep_read": recall(read), "compliant": F.when(read.isNotNull(), (F.size(read) > 0).cast("double")),
    }
