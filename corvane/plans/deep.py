"""Deep answers over the sample tables: reranking, parent contexts, coverage, citations, balanced picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import evidence
from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, chunks, table


@query("""WITH c AS (SELECT l_orderkey % 300 AS query_id, l_partkey AS chunk_id, min(l_linenumber) AS line, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line, chunk_id) AS rank, CASE WHEN query_id % 5 = 0 AND chunk_id % 11 = 0 THEN NULL ELSE q END AS s FROM c),
f AS (SELECT *, bool_and(s IS NOT NULL) OVER (PARTITION BY query_id) AS ok FROM r)
SELECT query_id, chunk_id, ok AS reranked, CASE WHEN ok THEN s END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN s END DESC NULLS LAST, rank) AS final_rank FROM f QUALIFY final_rank <= 8""")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a scorer that fails for some queries, which keep their fused order."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("query_id"), F.col("l_partkey").alias("chunk_id")).agg(F.min("l_linenumber").alias("line"), F.max("l_quantity").alias("q"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("line", "chunk_id")))
    score = F.when(~((F.col("query_id") % 5 == 0) & (F.col("chunk_id") % 11 == 0)), F.col("q"))
    return evidence.rerank(r, score, 8).select("query_id", "chunk_id", "reranked", "score", "final_rank")


@query(f"""WITH l AS ({SQL_CHUNKS}), c AS (SELECT document_id % 20 AS query_id, chunk_id, parent_id, length(text) % 101 AS score, text FROM l),
p AS (SELECT parent_id, string_agg(text, chr(10) ORDER BY line_no) AS ptext, min(line_no // 5) AS first_page, max(line_no // 5) AS last_page, min(line_no) FILTER (line_no % 4 = 1) AS heading_line FROM l WHERE document_id % 7 <> 0 GROUP BY parent_id),
b AS (SELECT query_id, parent_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, parent_id) AS parent_rank FROM c GROUP BY query_id, parent_id QUALIFY parent_rank <= 20),
t AS (SELECT b.*, p.* EXCLUDE (parent_id), c.text, strpos(ptext, c.text) AS place FROM b JOIN p USING (parent_id) JOIN c ON c.query_id = b.query_id AND c.parent_id = b.parent_id)
SELECT query_id, parent_id, parent_rank, score, count(*) AS children, count(*) FILTER (strpos(substr(ptext, place + 1), text) = 0) AS anchored,
  CAST(coalesce(sum(place - 1) FILTER (strpos(substr(ptext, place + 1), text) = 0), 0) AS BIGINT) AS starts, first_page, last_page, 'h' || heading_line AS heading
FROM t GROUP BY ALL""")
def parent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of each query's twenty best parents; those of some documents are gone."""
    l = chunks(spark, sf_dir)  # noqa: E741
    children = l.select((F.col("document_id") % 20).alias("query_id"), "chunk_id", "parent_id", (F.length("text") % 101).alias("score"), "text")
    held = l.where(F.col("document_id") % 7 != 0)
    parents = held.groupBy("parent_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("line_no", "text")))["text"]).alias("text"))
    blocks = held.select("parent_id", F.col("line_no").alias("ord"), F.floor(F.col("line_no") / 5).alias("page"), F.when(F.col("line_no") % 4 == 1, F.concat(F.lit("h"), F.col("line_no").cast("string"))).alias("heading"))
    out = evidence.load_parents(children, parents, blocks, 20)
    starts = F.aggregate("anchors", F.lit(0).cast("long"), lambda a, x: a + x["start"])
    return out.select("query_id", "parent_id", "parent_rank", "score", F.size("provenance").alias("children"), F.size("anchors").alias("anchored"), starts.alias("starts"), "first_page", "last_page", "heading")


@query("""WITH e AS (SELECT l_orderkey % 300 AS run_id, l_linenumber AS goal_id, l_suppkey % 5 AS requirement_id, bool_or(l_quantity > 30) AS covered FROM lineitem GROUP BY ALL),
d AS (SELECT *, bool_or(run_id % 9 = 0 AND goal_id = 1 AND covered) OVER (PARTITION BY run_id) AS degraded FROM e)
SELECT run_id, goal_id, count(*) AS requirements, count(*) FILTER (degraded OR NOT covered) AS missing, degraded,
  CASE WHEN bool_and(covered AND NOT degraded) THEN 'SATISFIED_LOCKED' WHEN run_id % 2 = 0 THEN 'REPAIR_EXHAUSTED' ELSE 'NEEDS_REPAIR' END AS state FROM d GROUP BY run_id, goal_id, degraded""")
def judged_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals by a judge's decisions, some of which cite what was never offered."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("run_id"), F.col("l_linenumber").alias("goal_id"), (F.col("l_suppkey") % 5).alias("requirement_id"), F.col("l_partkey").alias("evidence_id"), "l_quantity")  # noqa: E741
    key = ["run_id", "goal_id", "requirement_id"]
    decisions = l.groupBy(*key).agg(F.when(F.bool_or(F.col("l_quantity") > 30), "COVERED").otherwise("MISSING").alias("status"))
    good = l.where("l_quantity > 30").select(*key, "evidence_id")
    strange = good.where("run_id % 9 = 0 AND goal_id = 1").withColumn("evidence_id", -1 - F.col("evidence_id"))
    repaired = l.select("run_id").where("run_id % 2 = 0")
    return evidence.coverage(l.select(*key), decisions, good.union(strange), l.select(*key, "evidence_id"), repaired)


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 4 = 2 THEN [2] ELSE [doc_id % 4, 2] END AS marks FROM documents), m AS (SELECT doc_id, unnest(marks) AS mark FROM a)
SELECT a.doc_id AS answer_id, count(m.mark) AS cited, count(*) FILTER (m.mark IS NOT NULL AND NOT (m.mark BETWEEN 1 AND 3 AND (doc_id + m.mark) % 6 <> 0)) AS invalid, cited = 0 OR invalid > 0 AS failed FROM a LEFT JOIN m USING (doc_id) GROUP BY a.doc_id""")
def strict_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a citation, or with one that isn't valid, fail."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"))
    answers = d.withColumn("answer", F.when(F.col("answer_id") % 5 == 0, "none").otherwise(F.format_string("so it is [E%d] and [E2], [E2]", F.col("answer_id") % 4)))
    held = d.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    held = held.select("answer_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("mark"), ((F.col("answer_id") + F.col("n")) % 6 != 0).alias("valid"))
    return evidence.strict_citations(answers, held)


@query()
def balanced_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents of each source, spread over languages and lengths, by the order of a digest."""
    d = table(spark, sf_dir, "documents")
    return evidence.balanced_pick(d.select(F.coalesce("source", F.lit("")).alias("group_id"), F.col("doc_id").alias("item_id"), F.col("lang").alias("kind"), F.array((F.col("n_chars") % 40).cast("string")).alias("documents"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("rank")), 30)
