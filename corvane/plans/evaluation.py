"""Evaluation metrics: per case, aggregated, grouped, routing and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import health, metrics
from corvane.plans import query
from corvane.plans.model import table

#: Cases are customers; candidates their orders' parts by price; expected are small parts they ordered, forbidden the costliest.
SQL_CASES = """
cand AS (SELECT o_custkey AS case_id, l_partkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
expected AS (SELECT DISTINCT o_custkey AS case_id, l_partkey AS document_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 42),
forbidden AS (SELECT DISTINCT o_custkey AS case_id, l_partkey AS document_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.09),
docs AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, document_id) AS place FROM (SELECT case_id, document_id, min(rank) AS rank FROM cand GROUP BY ALL) QUALIFY place <= 10),
rel AS (SELECT d.*, CASE WHEN e.case_id IS NULL THEN 0 ELSE 1 END AS r, sum(CASE WHEN e.case_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY d.case_id ORDER BY place) AS found FROM docs d LEFT JOIN expected e USING (case_id, document_id)),
agg AS (SELECT case_id, min(CASE WHEN r = 1 THEN place END) AS first, count(*) FILTER (r = 1 AND place <= 5) AS m5, count(*) FILTER (r = 1) AS m10, count(*) FILTER (place <= 5) AS l5, count(*) AS l10,
  coalesce(sum(CASE WHEN r = 1 AND place <= 5 THEN 1 / log2(place + 1) END), 0) AS d5, coalesce(sum(CASE WHEN r = 1 THEN 1 / log2(place + 1) END), 0) AS d10,
  coalesce(sum(CASE WHEN r = 1 AND place <= 5 THEN found / place END), 0) AS p5, coalesce(sum(CASE WHEN r = 1 THEN found / place END), 0) AS p10 FROM rel GROUP BY case_id),
n AS (SELECT case_id, count(*) AS n FROM expected GROUP BY case_id), fh AS (SELECT case_id, count(*) AS h FROM docs JOIN forbidden USING (case_id, document_id) GROUP BY case_id),
c AS (SELECT c_custkey AS case_id, coalesce(n.n, 0) AS n, first, coalesce(m5, 0) AS m5, coalesce(m10, 0) AS m10, coalesce(l5, 0) AS l5, coalesce(l10, 0) AS l10, coalesce(d5, 0) AS d5, coalesce(d10, 0) AS d10, coalesce(p5, 0) AS p5, coalesce(p10, 0) AS p10, coalesce(h, 0) AS h
  FROM customer LEFT JOIN n ON n.case_id = c_custkey LEFT JOIN agg ON agg.case_id = c_custkey LEFT JOIN fh ON fh.case_id = c_custkey),
per AS (SELECT case_id, n AS n_expected, CASE WHEN n > 0 THEN m5 / n ELSE 0 END AS recall5, CASE WHEN n > 0 THEN m10 / n ELSE 0 END AS recall10, CASE WHEN l5 > 0 THEN m5 / l5 ELSE 0 END AS precision5, CASE WHEN l10 > 0 THEN m10 / l10 ELSE 0 END AS precision10,
  CASE WHEN first <= 5 THEN 1 / first ELSE 0 END AS mrr5, coalesce(1 / first, 0) AS mrr10,
  CASE WHEN least(l5, n, 5) > 0 THEN d5 / list_sum(list_transform(range(1, least(l5, n, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg5,
  CASE WHEN least(l10, n, 10) > 0 THEN d10 / list_sum(list_transform(range(1, least(l10, n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg10,
  CASE WHEN n > 0 THEN p5 / least(5, n) ELSE 0 END AS map5, CASE WHEN n > 0 THEN p10 / least(10, n) ELSE 0 END AS map10, CAST(coalesce(first <= 5, false) AS INTEGER) AS hit5, CAST(first IS NOT NULL AS INTEGER) AS hit10, h AS forbidden_hits FROM c)"""
MEASURES = ["recall5", "recall10", "precision5", "precision10", "mrr5", "mrr10", "ndcg5", "ndcg10", "map5", "map10"]


def per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_id"))
    x = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    w = Window.partitionBy("case_id").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    cand = x.select("case_id", F.col("l_partkey").alias("document_id"), F.row_number().over(w).alias("rank"))
    pick = lambda c: x.where(c).select("case_id", F.col("l_partkey").alias("document_id"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    return metrics.case_metrics(cases, cand, pick("l_quantity > 42"), pick("l_discount > 0.09D"))


@query(f"WITH {SQL_CASES} SELECT case_id, n_expected, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)}, hit5, hit10, forbidden_hits FROM per")
def ir_metrics_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_case(spark, sf_dir).select("case_id", "n_expected", *[F.round(m, 6).alias(m) for m in MEASURES], "hit5", "hit10", "forbidden_hits")


SQL_MEANS = ", ".join(f"round(coalesce(avg({m}) FILTER (n_expected > 0), 0), 6) AS {m}" for m in ("recall5", "recall10", "mrr5", "hit5", "hit10")) + ", " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision5", "precision10", "ndcg5", "ndcg10", "map5", "map10"))


@query(f"WITH {SQL_CASES} SELECT count(*) AS n_cases, count(*) FILTER (n_expected > 0) AS n_graded, {SQL_MEANS} FROM per")
def ir_metrics_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aggregate_metrics(per_case(spark, sf_dir))


@query(f"WITH {SQL_CASES} SELECT c_mktsegment AS grp, count(*) AS n_cases, count(*) FILTER (n_expected > 0) AS n_graded, {SQL_MEANS} FROM per JOIN customer ON c_custkey = case_id GROUP BY c_mktsegment")
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("grp"))
    return metrics.aggregate_metrics(per_case(spark, sf_dir).join(kinds, "case_id"), ["grp"])


SQL_ROUTES = """r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'DEEP' WHEN event_id % 3 = 1 THEN 'FAST' ELSE 'NONE' END AS e, CASE WHEN event_type IN ('view', 'click') THEN 'FAST' WHEN event_type = 'error' THEN 'ERROR' ELSE 'DEEP' END AS s, event_type = 'signup' AS fb FROM events)"""


@query(f"""WITH {SQL_ROUTES}, g AS (SELECT *, e IN ('FAST', 'DEEP') AS graded FROM r)
SELECT count(*) FILTER (graded) AS graded, count(*) FILTER (graded AND e = s) AS correct, round(count(*) FILTER (graded AND e = s) / count(*) FILTER (graded), 6) AS accuracy,
  round(count(*) FILTER (e = 'FAST' AND s = 'FAST') / count(*) FILTER (e = 'FAST'), 6) AS fast_recall, round(count(*) FILTER (e = 'DEEP' AND s = 'DEEP') / count(*) FILTER (e = 'DEEP'), 6) AS deep_recall,
  round(count(*) FILTER (e = 'FAST' AND s = 'FAST') / count(*) FILTER (graded AND s = 'FAST'), 6) AS fast_precision, round(count(*) FILTER (e = 'DEEP' AND s = 'DEEP') / count(*) FILTER (graded AND s = 'DEEP'), 6) AS deep_precision,
  count(*) FILTER (fb) AS fallbacks, round(count(*) FILTER (fb) / count(*), 6) AS fallback_rate, {', '.join(f"count(*) FILTER (e = '{a}' AND s = '{b}') AS {a.lower()}_to_{b.lower()}" for a in ('FAST', 'DEEP') for b in ('FAST', 'DEEP', 'ERROR'))} FROM g""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = F.col("event_id") % 3, F.col("event_type")
    r = table(spark, sf_dir, "events").select(
        F.when(m == 0, "DEEP").when(m == 1, "FAST").otherwise("NONE").alias("expected_mode"), F.when(t.isin("view", "click"), "FAST").when(t == "error", "ERROR").otherwise("DEEP").alias("selected_mode"), F.lit("LLM").alias("source"), (t == "signup").alias("fallback")
    )
    return metrics.routing_metrics(r)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*metrics.nearest_rank("value", 0.5, 0.95, 0.99), F.round(metrics.mean("value"), 6).alias("mean"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS cost, round(sum(value) / count(*), 6) AS per_call FROM events GROUP BY ALL")
def cost_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("per_call"))


@query("""SELECT r_name, n_name, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())""")
def independent_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent groupings of one set of cases in one pass."""
    for n in ("customer", "nation", "region"):
        table(spark, sf_dir, n).createOrReplaceTempView(f"g_{n}")
    return spark.sql("""SELECT r_name, n_name, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM g_customer JOIN g_nation ON n_nationkey = c_nationkey JOIN g_region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())""")


#: Messages of failed runs, by an event's number.
MESSAGES = ["HTTP 401 from the provider", "Rate limit: too many requests", "http 503", "Judge timed out", "the router failed", "Coverage judge broke", "deep read failed", "search index: Forbidden", "odd", None]
SQL_MESSAGES = f"e AS (SELECT event_id, event_type, user_id, k, CASE k % {len(MESSAGES)} {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES) if m)} END AS message FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


@query(f"""WITH {SQL_MESSAGES}, a AS (SELECT *, coalesce(regexp_matches(message, 'HTTP (401|403)|Unauthorized|Forbidden|authentication failed|authorization failed'), false) AS auth, lower(message) AS m FROM e)
SELECT event_id, auth, NOT auth AND coalesce(regexp_matches(m, 'timed out|timeout|rate limit|too many requests|connection reset|connection refused|(temporarily|service) unavailable|http (429|5[0-9][0-9])'), false) AS transient,
  CASE WHEN m IS NULL THEN NULL WHEN regexp_matches(m, 'timed out|timeout') THEN 'TIMEOUT' WHEN regexp_matches(m, 'authentication|unauthorized|forbidden') THEN 'PROVIDER_AUTH' WHEN regexp_matches(m, 'routing|router') THEN 'ROUTING'
    WHEN regexp_matches(m, 'judge|coverage') THEN 'EVIDENCE_JUDGE' WHEN regexp_matches(m, 'deep|evidence') THEN 'DEEP_READ' WHEN regexp_matches(m, 'retriev|search') THEN 'RETRIEVAL' ELSE 'RAG_RUN' END AS phase FROM a""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs that failed with one of several messages: refused credentials, passing faults, and the phase."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), k % len(MESSAGES) + 1).alias("message"))
    m = F.col("message")
    return e.select("event_id", health.authentication_failure(m).alias("auth"), health.transient_failure(m).alias("transient"), health.failure_phase(m).alias("phase"))


@query(f"""WITH {SQL_MESSAGES}, r AS (SELECT event_id, event_type <> 'view' AND user_id % 4 < 3 AS applies, user_id % 4 = 1 AS by_goal, k % 10 = 0 AS lost, k % 5 = 1 AS support, k % 7 = 2 AS failed, k % 11 = 3 AS hidden, k % 4 AS judged, k % 3 AS goals FROM e)
SELECT event_id, CASE WHEN applies THEN CASE WHEN lost THEN 'diagnostics missing' ELSE concat_ws(', ', CASE WHEN support THEN 'failed support action' END, CASE WHEN failed THEN 'failed model logical call' END,
  CASE WHEN hidden THEN 'hidden evidence outcome' END, CASE WHEN NOT (judged = 1 OR (by_goal AND goals > 0 AND judged = goals)) THEN 'unexpected evidence judge call count' END) END END AS reasons FROM r""")
def degraded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished runs with diagnostics, and why they are no healthy samples; older runs count attempts instead of calls."""
    k = F.get_json_object("props", "$.k").cast("int")
    flag = lambda c: c.cast("int").cast("string")
    calls = F.when(k % 2 == 0, F.concat(F.lit('"modelFailedAttemptCount": '), flag(k % 7 == 2))).otherwise(F.concat(F.lit('"modelFailedAttemptCount": 9, "modelFailedLogicalCallCount": '), flag(k % 7 == 2)))
    diagnostics = F.when(k % 10 != 0, F.concat(F.lit('{"failedSupportActionCount": '), flag(k % 5 == 1), F.lit(', "hiddenEvidenceOutcomeCount": '), flag(k % 11 == 3), F.lit(', "judgeCallCount": '), (k % 4).cast("string"), F.lit(', "primaryGoalCount": '), (k % 3).cast("string"), F.lit(", "), calls, F.lit("}")))
    pipeline = F.element_at(F.array(F.lit("agentic-rag-v4"), F.lit("agentic-rag-v8"), F.lit("agentic-rag-v7"), F.lit("other")), (F.col("user_id") % 4 + 1).cast("int"))
    mode = F.when(F.col("event_type") != "view", "DEEP").otherwise("FAST")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(health.degradations(mode, pipeline, diagnostics), ", ").alias("reasons"))


@query("""SELECT o_orderkey, 'KEPT' AS state FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'RERUN' FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice <= 1000""")
def resume_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy results are kept, all other cases run again."""
    o = table(spark, sf_dir, "orders")
    healthy = o.where("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey")
    return healthy.withColumn("state", F.lit("KEPT")).unionByName(o.join(healthy, "o_orderkey", "left_anti").select("o_orderkey", F.lit("RERUN").alias("state")))


@query("""WITH a AS (SELECT doc_id, doc_id % 2 = 0 AS expects, substr(text, 1, 30) || CASE WHEN doc_id % 3 = 0 THEN ' cannot determine' ELSE '' END AS answer FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (expects = (contains(lower(answer), 'cannot determine'))) AS correct FROM a""")
def no_answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    answer = F.concat(F.substring("text", 1, 30), F.when(F.col("doc_id") % 3 == 0, " cannot determine").otherwise(""))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("doc_id") % 2 == 0) == text.abstains(answer)).alias("correct"))


@query("""WITH e AS (SELECT l_orderkey % 300 AS run_id, l_linenumber AS goal_id, l_suppkey % 5 AS requirement_id, bool_or(l_quantity > 30) AS covered FROM lineitem GROUP BY ALL)
SELECT run_id, goal_id, count(*) AS requirements, count(*) FILTER (NOT covered) AS missing, CASE WHEN bool_and(covered) THEN 'SATISFIED_LOCKED' ELSE 'NEEDS_REPAIR' END AS state FROM e GROUP BY run_id, goal_id""")
def coverage_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("run_id"), F.col("l_linenumber").alias("goal_id"), (F.col("l_suppkey") % 5).alias("requirement_id")).agg(F.bool_or(F.col("l_quantity") > 30).alias("covered"))
    return e.groupBy("run_id", "goal_id").agg(F.count(F.lit(1)).alias("requirements"), F.count_if(~F.col("covered")).alias("missing"), F.when(F.bool_and("covered"), "SATISFIED_LOCKED").otherwise("NEEDS_REPAIR").alias("state"))


@query("""WITH s AS (SELECT o_custkey AS candidate, max(l_discount) AS best, count(DISTINCT l_partkey) AS docs, count(DISTINCT (l_partkey, l_suppkey)) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount >= 0.05 GROUP BY o_custkey)
SELECT candidate, round(best + least(docs, 3) * 0.04 + least(evidence, 4) * 0.01, 6) AS quality, evidence >= 1 AS fast_ok, evidence >= 2 AS deep_ok FROM s""")
def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("candidate"))
    s = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05D").join(o, "l_orderkey").groupBy("candidate").agg(F.max("l_discount").alias("best"), F.count_distinct("l_partkey").alias("docs"), F.count_distinct("l_partkey", "l_suppkey").alias("evidence"))
    return s.select("candidate", F.round(F.col("best") + F.least("docs", F.lit(3)) * 0.04 + F.least("evidence", F.lit(4)) * 0.01, 6).alias("quality"), (F.col("evidence") >= 1).alias("fast_ok"), (F.col("evidence") >= 2).alias("deep_ok"))


@query("""WITH t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n, text FROM benchmark)
SELECT a.item_id, kind, CASE WHEN kind = 'cross' THEN b.item_id END AS other_id FROM t a CROSS JOIN (VALUES ('direct'), ('cross'), ('no-answer')) k(kind) JOIN t b ON b.i = (a.i + 7) % a.n""")
def case_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of cases from each item; a cross-document case names the item seven places on."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "benchmark").select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("i"))
    n = t.count()
    other = t.select(F.col("item_id").alias("other"), F.col("i").alias("j"))
    pairs = t.withColumn("j", (F.col("i") + 7) % n).join(other, "j")
    return pairs.select("item_id", "other", F.explode(F.array(F.lit("direct"), F.lit("cross"), F.lit("no-answer"))).alias("kind")).select("item_id", "kind", F.when(F.col("kind") == "cross", F.col("other")).alias("other_id"))
