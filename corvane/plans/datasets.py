"""Evaluation data sets from documents: evidence, cases, harder cases, and what is wrong with a set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import datasets
from corvane.plans import query
from corvane.plans.model import table

#: Letters become ideographs, so that documents read as Chinese Markdown: lines that begin with 天 are headings, with 地 fences, with 日 tables.
LETTERS = "abcdefghijklmnopqrstuvwxyz."
SIGNS = "天地日月山水火木金土人口手足目耳心门马鸟鱼虫石田车舟。"
MARKS = {"天": "# 天", "地": "```地", "日": "|日"}


def _shaped_sql(text: str) -> str:
    out = f"replace(translate(lower({text}), '{LETTERS}', '{SIGNS}'), chr(10), chr(10) || chr(10))"
    for sign, marked in MARKS.items():
        out = f"replace({out}, chr(10) || '{sign}', chr(10) || '{marked}')"
    return out


def _shaped(text: str):
    out = F.replace(F.translate(F.lower(text), LETTERS, SIGNS), F.lit("\n"), F.lit("\n\n"))
    for sign, marked in MARKS.items():
        out = F.replace(out, F.lit(f"\n{sign}"), F.lit(f"\n{marked}"))
    return out


ID, END = "[㐀-䶿一-鿿]", "[。！？；]"
BEFORE = "OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL_EVIDENCE = rf"""
cut AS (SELECT doc_id AS document_id, source, regexp_split_to_array({_shaped_sql('text')}, '\n\s*\n') AS b FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT document_id, source, n, block, starts_with(block, '```') AS fence, len(regexp_extract_all(block, '```')) % 2 = 1 AS odd FROM (SELECT document_id, source, generate_subscripts(b, 1) - 1 AS n, regexp_replace(unnest(b), '^\s+|\s+$', '', 'g') AS block FROM cut) WHERE block <> ''),
coded AS (SELECT *, coalesce(last_value(CASE WHEN fence THEN odd END IGNORE NULLS) {BEFORE}, false) AS in_code FROM blocks),
titled AS (SELECT *, CASE WHEN regexp_matches(block, '^#{{1,6}}\s+.+$') THEN trim(regexp_replace(regexp_replace(regexp_extract(block, '^#{{1,6}}\s+(.+)$', 1), '[`*_]', '', 'g'), '\s+', ' ', 'g')) END AS title FROM coded WHERE NOT fence AND NOT in_code),
headed AS (SELECT *, coalesce(last_value(title IGNORE NULLS) {BEFORE}, 'Document') AS heading FROM titled),
lines AS (SELECT document_id, source, n, heading, trim(regexp_replace(block, '\s+', ' ', 'g')) AS line FROM headed WHERE title IS NULL AND NOT starts_with(block, '|') AND len(regexp_extract_all(block, '\|')) <= 8 AND len(regexp_extract_all(block, '{ID}')) >= 35),
ends AS (SELECT *, regexp_extract(substr(line, 1, 221), '^(?:[^㐀-䶿一-鿿]*{ID}){{35}}[^。！？；]*{END}') AS sentence, regexp_extract(substr(line, 1, 221), '^(.{{120,220}}) ', 1) AS words FROM lines),
evidence AS (SELECT document_id, source, n, heading, CASE WHEN sentence <> '' THEN sentence WHEN length(line) <= 220 THEN line WHEN words <> '' THEN words ELSE substr(line, 1, 220) END AS quote FROM ends
  WHERE len(regexp_extract_all(quote, '{ID}')) >= 35 QUALIFY row_number() OVER (PARTITION BY document_id, lower(regexp_replace(quote, '[^0-9a-zA-Z㐀-䶿一-鿿]+', '', 'g')) ORDER BY n) = 1)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), _shaped("text").alias("text"))


@query(f"WITH {SQL_EVIDENCE} SELECT document_id, n, heading, quote FROM evidence")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole documents that can be quoted, under their headings."""
    return datasets.evidence_blocks(_documents(spark, sf_dir))


@query(rf"""WITH {SQL_EVIDENCE}, two AS (SELECT document_id, source, max(heading) FILTER (r = 1) AS h1, max(quote) FILTER (r = 1) AS q1, max(heading) FILTER (r = 2) AS h2, max(quote) FILTER (r = 2) AS q2
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n) AS r FROM evidence) WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2),
answered AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(regexp_replace(q1, '^\s*(?:[-+*]|\d+[.)])\s+', ''), '[`*_]', '', 'g'), '\s+', ' ', 'g')) AS q1, trim(regexp_replace(regexp_replace(regexp_replace(q2, '^\s*(?:[-+*]|\d+[.)])\s+', ''), '[`*_]', '', 'g'), '\s+', ' ', 'g')) AS q2), row_number() OVER (PARTITION BY source ORDER BY document_id) - 1 AS i FROM two)
SELECT 'direct_fact' AS category, source, CAST(document_id AS VARCHAR) AS documents, 'What does Document ' || document_id || ' state in its part ' || h1 || '?' AS question, q1 AS expected_answer, 'FAST' AS mode FROM answered
UNION ALL SELECT 'procedure_condition', source, CAST(document_id AS VARCHAR), 'Which steps or conditions does Document ' || document_id || ' give under ' || h2 || '?', q2, 'FAST' FROM answered
UNION ALL SELECT 'cross_document', a.source, a.document_id || ',' || b.document_id, 'Summarize what Document ' || a.document_id || ' says under ' || a.h1 || ' and what Document ' || b.document_id || ' says under ' || b.h1 || '.',
  'Document ' || a.document_id || ': ' || a.q1 || ' Document ' || b.document_id || ': ' || b.q1, 'DEEP' FROM answered a JOIN answered b ON a.source = b.source AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.i < 12""")
def case_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their answers from every document, and on neighbours of a source."""
    d = _documents(spark, sf_dir)
    c = datasets.synthesize_cases(d, datasets.evidence_blocks(d))
    return c.select("category", "source", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("documents"), "question", "expected_answer", "mode")


@query("""WITH t AS (SELECT source, doc_id, 'part ' || lang AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), r AS (SELECT * FROM t WHERE n >= 50 AND i < 50)
SELECT 'multi_intent' AS challenge, a.source, a.i AS place, a.doc_id || ',' || b.doc_id AS documents, 'Two separate goals came up: ' || coalesce(a.topic, '') || '; ' || coalesce(b.topic, '') || '. Find the conditions, steps and limits of each.' AS question FROM r a JOIN r b ON b.source = a.source AND b.i = (a.i + 23) % 50 WHERE a.i < 20
UNION ALL SELECT 'query_decomposition', a.source, a.i, a.doc_id || ',' || b.doc_id || ',' || c.doc_id, 'Plan three phases: first ' || coalesce(a.topic, '') || '; second ' || coalesce(b.topic, '') || '; third ' || coalesce(c.topic, '') || '. Which rules does each rest on?'
  FROM r a JOIN r b ON b.source = a.source AND b.i = (a.i + 17) % 50 JOIN r c ON c.source = a.source AND c.i = (a.i + 34) % 50 WHERE a.i < 15
UNION ALL SELECT 'semantic_paraphrase', source, i, CAST(doc_id AS VARCHAR), 'Nobody recalls the document, only that it is about ' || coalesce(topic, '') || '. What are its conditions and limits?' FROM r WHERE i BETWEEN 30 AND 39
UNION ALL SELECT 'keyword_sparse', source, i, CAST(doc_id AS VARCHAR), 'A ticket says only: ' || coalesce(topic, '') || '. Which requirements apply?' FROM r WHERE i BETWEEN 45 AND 49""")
def challenge_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harder questions on one to three documents of a source, of four kinds."""
    t = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("document_id"), F.concat(F.lit("part "), "lang").alias("topic"))
    c = datasets.synthesize_challenges(t)
    return c.select("challenge", "source", "place", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("documents"), "question")


@query("""WITH d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^0-9a-zA-Z㐀-䶿一-鿿]+', '', 'g')) <> '' AS has_key FROM documents),
c AS (SELECT doc_id, k, doc_id * 2 + k AS case_id, CASE WHEN doc_id % 13 = 0 AND k = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN 'Question ' || doc_id ELSE 'Question ' || doc_id || ' ' || k END AS question, doc_id % 17 = 0 AND k = 1 AS unknown FROM d CROSS JOIN (VALUES (0), (1)) v(k) WHERE doc_id % 11 <> 0 OR k = 0)
SELECT 'blank question' AS rule, CAST(case_id AS VARCHAR) AS subject, 1 AS n FROM c WHERE question = ' '
UNION ALL SELECT 'repeated question', question, count(*) FROM c WHERE question <> ' ' GROUP BY question HAVING count(*) > 1
UNION ALL SELECT 'unknown document', CAST(case_id AS VARCHAR), 1 FROM c WHERE unknown
UNION ALL SELECT 'quote not in document', CAST(case_id AS VARCHAR), 1 FROM c WHERE NOT unknown AND doc_id % 19 = 0
UNION ALL SELECT 'cases of document', CAST(doc_id AS VARCHAR), count(*) FILTER (NOT unknown) FROM c GROUP BY doc_id HAVING count(*) FILTER (NOT unknown) <> 2
UNION ALL SELECT 'cases of category', 'procedure_condition', count(*) FROM c WHERE k = 1 HAVING count(*) <> 7""")
def case_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cases a document, some with planted faults, against the documents' whole texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    i, k = F.col("document_id"), F.col("k")
    c = d.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where((i % 11 != 0) | (k == 0))
    blank, pair = (i % 13 == 0) & (k == 0), i % 7 == 0
    question = F.when(blank, " ").when(pair, F.concat(F.lit("Question "), i.cast("string"))).otherwise(F.concat(F.lit("Question "), i.cast("string"), F.lit(" "), k.cast("string")))
    known = F.when((i % 17 == 0) & (k == 1), i + 10**9).otherwise(i)
    quote = F.when(i % 19 == 0, F.concat(F.lit("planted words that no document holds"), i.cast("string"))).otherwise(F.col("text"))
    cases = c.select((i * 2 + k).alias("case_id"), F.when(k == 0, "direct_fact").otherwise("procedure_condition").alias("category"), question.alias("question"), F.array(known).alias("document_ids"), F.array(quote).alias("quotes"))
    firsts = cases.where("category = 'direct_fact'").count()
    return datasets.case_violations(cases, d, categories={"direct_fact": firsts, "procedure_condition": 7})
