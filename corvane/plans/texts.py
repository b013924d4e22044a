"""Text measures, routing, identifiers and parsers over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import routing, text
from corvane.operators import chunking, packing, quality
from corvane.operators.questions import route_table, similar_texts
from corvane.plans import query
from corvane.plans.model import table
from corvane.sources import parsers
from corvane.sources.folders import stored

WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


@query(rf"""
SELECT doc_id,
  CAST(list_sum(list_transform(regexp_extract_all(text, '{WIDE}|[\p{{L}}\p{{N}}_-]+|[^\s]'), lambda t: CASE WHEN regexp_full_match(t, '[\p{{L}}\p{{Nd}}_-]+') THEN (length(t) + 3) // 4 ELSE 1 END)) AS BIGINT) AS lexical,
  greatest(1, length(text) - length(regexp_replace(text, '[㐀-鿿]', '', 'g')) + (length(regexp_replace(text, '[㐀-鿿]', '', 'g')) + 3) // 4) AS packing,
  greatest(1, length(text) - length(regexp_replace(text, '{WIDE}', '', 'g')) + (length(regexp_replace(text, '{WIDE}', '', 'g')) + 3) // 4) AS script
FROM documents WHERE text IS NOT NULL""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", text.lexical_tokens(F.col("text")).alias("lexical"), text.packing_tokens(F.col("text")).alias("packing"), text.script_tokens(F.col("text")).alias("script"))


SQL_GRAMS = "list_distinct(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) = 1 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)) END)"


@query(f"""
WITH t AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, max(CASE WHEN turn = 1 THEN text END) AS a FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, regexp_replace(lower(coalesce(q, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS q, regexp_replace(lower(coalesce(a, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS a FROM t),
g AS (SELECT conv_id, {SQL_GRAMS.format('q')} AS q, {SQL_GRAMS.format('a')} AS a FROM n)
SELECT conv_id, len(q) AS n_pairs, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS coverage,
  round(CASE WHEN len(q) = 0 AND len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) END, 6) AS jaccard FROM g""")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("a"))
    q, a = (text.grams(F.coalesce(F.col(c), F.lit(""))) for c in ("q", "a"))
    return t.select("conv_id", F.size(q).alias("n_pairs"), F.round(text.coverage(F.col("q"), F.col("a")), 6).alias("coverage"), F.round(text.jaccard(q, a), 6).alias("jaccard"))


@query(r"""
WITH q AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\p{P}\p{S}\s]', '', 'g') AS n FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2)))) AS g, len(list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2)))) AS c FROM q WHERE length(n) > 1),
m AS (SELECT a.conv_id AS a_id, b.conv_id AS b_id, a.turn AS a_turn, b.turn AS b_turn, a.c AS ca, b.c AS cb, count(*) AS common FROM p a JOIN p b ON a.g = b.g AND (a.conv_id, a.turn) < (b.conv_id, b.turn) GROUP BY ALL)
SELECT a_id, a_turn, b_id, b_turn, round(common / (ca + cb - common), 6) AS similarity FROM m WHERE common / (ca + cb - common) >= 0.72""")
def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions whose character pairs agree to 0.72 or more: pairs of different texts, and questions of one text."""
    q = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", text.comparison_text(F.col("text")).alias("n")).where(F.length("n") > 1)
    q = stored(q)
    each = q.select(F.col("n").alias("text")).distinct()
    met = similar_texts(each.withColumn("size", F.size(text.pairs_of(F.col("text")))), 0.72)
    left, right = (q.select(F.struct("conv_id", "turn").alias(c), F.col("n").alias(f"{c}_text")) for c in "ab")
    both = met.join(left, "a_text").join(right, "b_text").select("a", "b", "similarity")
    same = left.join(right, (F.col("a_text") == F.col("b_text")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("similarity"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    out = both.where(low < high).unionByName(same).select(low.alias("a"), high.alias("b"), F.round("similarity", 6).alias("similarity"))
    return out.select(F.col("a.conv_id").alias("a_id"), F.col("a.turn").alias("a_turn"), F.col("b.conv_id").alias("b_id"), F.col("b.turn").alias("b_turn"), "similarity")


QUESTIONS = [
    (1, "请比较 Kubernetes 与 Docker 的差异"), (2, "根据《部署手册》，备份部分的要求是什么"), (3, "《甲》和《乙》有什么区别"), (4, ""), (5, "为什么任务失败，如何修复"),
    (6, "etcdctl snapshot 怎么用"), (7, "是否在文档里说明了限流"), (8, "第一阶段检查集群，第二阶段分别处理部署手册"), (9, "同时说明部署手册和运维手册"), (10, "今天怎么样"),
    (11, "综合多份资料说明"), (12, "两份记录是否矛盾"), (13, "how does the and for"), (14, "  \t "), (15, "你好！"), (16, "我们公司的研发规范"), (17, "hello, 你能做什么"), (18, "它的上限是多少"),
]


@query("""
SELECT doc_id, mode, reason, demand, final_mode, title_hits FROM documents JOIN (VALUES
 (1, 'DEEP', 'auto-deep-comparison', 'GENERAL', 'DEEP', 0), (2, 'FAST', 'auto-fast-explicit-document', 'GENERAL', 'FAST', 1), (3, 'DEEP', 'auto-deep-multi-document', 'GENERAL', 'DEEP', 0),
 (4, 'DEEP', 'auto-deep-empty', 'GENERAL', 'DEEP', 0), (5, 'DEEP', 'auto-deep-diagnose-repair', 'GENERAL', 'DEEP', 0), (6, 'FAST', 'auto-fast-technical-anchor', 'GENERAL', 'FAST', 0),
 (7, 'FAST', 'auto-fast-simple-lookup', 'GENERAL', 'FAST', 0), (8, 'DEEP', 'auto-deep-multi-goal', 'GENERAL', 'DEEP', 1), (9, 'DEEP', 'auto-deep-multi-goal', 'GENERAL', 'FAST', 2),
 (10, 'DEEP', 'auto-deep-uncertain', 'GENERAL', 'DEEP', 0), (11, 'DEEP', 'auto-deep-synthesis', 'GENERAL', 'DEEP', 0), (12, 'DEEP', 'auto-deep-conflict', 'GENERAL', 'DEEP', 0),
 (13, 'DEEP', 'auto-deep-uncertain', 'GENERAL', 'DEEP', 0), (14, 'DEEP', 'auto-deep-empty', 'GENERAL', 'DEEP', 0), (15, 'DEEP', 'auto-deep-uncertain', 'NONE', 'DEEP', 0),
 (16, 'DEEP', 'auto-deep-uncertain', 'ORGANIZATION_SPECIFIC', 'DEEP', 0), (17, 'FAST', 'auto-fast-technical-anchor', 'NONE', 'FAST', 0), (18, 'DEEP', 'auto-deep-uncertain', 'GENERAL', 'DEEP', 0)
) t(question_id, mode, reason, demand, final_mode, title_hits) ON question_id = doc_id % 18 + 1""")
def router_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name documents by their titles, one for each document, and where they go before and after a look at the titles found for them."""
    forms = F.broadcast(spark.createDataFrame(QUESTIONS, "form int, question string"))  # 18 rows
    title = lambda n: F.concat(F.lit("手册"), F.lpad(n.cast("string"), 9, "0"), F.lit("号"))
    d = table(spark, sf_dir, "documents").select("doc_id", title(F.col("doc_id")).alias("own"), title(F.col("doc_id") + 1).alias("next"))
    q = d.join(forms, F.col("form") == F.col("doc_id") % 18 + 1)
    q = q.select(F.col("doc_id").alias("question_id"), F.replace(F.replace("question", F.lit("部署手册"), F.col("own")), F.lit("运维手册"), F.col("next")).alias("question"), "own", "next")
    found = q.select("question_id", F.explode(F.array("own", "next", "own", F.lit("ab"))).alias("title"))
    out = route_table(q.select("question_id", "question"), found)
    return out.select(F.col("question_id").alias("doc_id"), "mode", "reason", "demand", "final_mode", F.col("title_hits").cast("int").alias("title_hits"))


@query(r"""
WITH t AS (SELECT item_id, text AS q FROM benchmark),
a AS (SELECT item_id, q, list_filter(regexp_extract_all(trim(regexp_replace(q, '\s+', ' ', 'g')), '(^|[^A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{2,})', 2), lambda w: lower(w) NOT IN ('what','how','why','which','when','who','the','and','for','from','into','with','without','does','are','can','should')) AS anchors FROM t)
SELECT item_id, CASE WHEN trim(q) = '' THEN 'DEEP' WHEN len(anchors) > 0 THEN 'FAST' ELSE 'DEEP' END AS mode, length(q) < 36 OR regexp_matches(q, 'those|that|it') AS rewrite FROM a""")
def router_on_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    return t.select("item_id", routing.route(F.col("q"))["mode"].alias("mode"), routing.needs_rewrite(F.col("q"), F.lit(True)).alias("rewrite"))


@query(r"""
WITH a AS (SELECT doc_id, text || ' [E' || (doc_id % 3 + 1) || '] and [E' || (doc_id % 5 + 1) || '] [E1]' || CASE WHEN doc_id % 10 = 0 THEN ' We CANNOT
 determine it.' ELSE '' END AS answer FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_distinct(regexp_extract_all(answer, '\[(E\d+)\]', 1)).list_sort() AS cited, len(list_filter(list_distinct(regexp_extract_all(answer, '\[(E\d+)\]', 1)), lambda c: c NOT IN ('E1', 'E2', 'E3'))) AS invalid,
  doc_id % 10 = 0 AS abstains, length(regexp_replace(answer, '\[E[45]\]', '', 'g')) AS kept_chars FROM a""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation marks of answers, those that name no evidence, and the answer without them."""
    n = lambda m: (F.col("doc_id") % m + 1).cast("string")
    tail = F.when(F.col("doc_id") % 10 == 0, F.lit(" We CANNOT\n determine it.")).otherwise("")
    a = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.concat("text", F.lit(" [E"), n(3), F.lit("] and [E"), n(5), F.lit("] [E1]"), tail).alias("answer"))
    cited = text.citations(F.col("answer"))
    return a.select("doc_id", F.sort_array(cited).alias("cited"), F.size(F.array_except(cited, F.array(*[F.lit(e) for e in ("E1", "E2", "E3")]))).alias("invalid"), text.abstains(F.col("answer")).alias("abstains"), F.length(F.regexp_replace("answer", r"\[E[45]\]", "")).alias("kept_chars"))


@query("""
SELECT o_orderkey, sha256(o_orderstatus || chr(31) || o_orderpriority) AS digest,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT *, md5('order:' || o_orderkey) AS h FROM orders)""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", F.sha2(F.concat_ws("\x1f", "o_orderstatus", "o_orderpriority").cast("binary"), 256).alias("digest"), text.name_uuid(key).alias("uuid"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[ \t]*\n+')) AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\f\v]+', ' ', 'g'), ' ')), chr(10)), '^\n+|\n+$', '', 'g') AS t FROM p)
SELECT doc_id AS document_id, count(*) AS n_blocks, CAST(sum(length(t)) AS BIGINT) AS n_chars, max(length(t)) AS largest FROM c WHERE t <> '' GROUP BY doc_id""")
def plain_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parsers.text_blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return b.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("largest"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.html_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("text")))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: each fourth line a heading, some lines lists, tables and code."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    def dress(x, i):
        return (
            F.when(i % 8 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 8) % 3 + 1).cast("int")), F.lit(" "), F.substring(x, 1, 40), F.lit("\n")))
            .when(i % 8 == 3, F.concat(F.lit("- "), x, F.lit("\n- second\n")))
            .when(i % 8 == 5, F.concat(F.lit("```sql\nSELECT 1\n\nFROM t\n```\n"), x))
            .when(i % 8 == 6, F.concat(F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n\n"), x))
            .otherwise(F.concat(x, F.lit("\n")))
        )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(F.transform(lines, dress), "\n").alias("text"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.markdown_blocks(_markdown(spark, sf_dir))


#: Characters of a document from which on its stretches are dealt to tasks of their own.
LONG = 2_000_000


def _chunks(spark: SparkSession, sf_dir: str, policy: chunking.Policy = chunking.Policy()) -> DataFrame:
    """Documents in chunks, whose stretches are dealt where there is a long one."""
    longest = table(spark, sf_dir, "documents").agg(F.max(F.length("text"))).first()[0] or 0
    return chunking.parent_child(parsers.markdown_blocks(_markdown(spark, sf_dir)), policy, deal=longest > LONG)


@query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, chunking.Policy(160, 190, 20, 40, 55, 8, "small")).drop("pieces")


@query()
def chunk_source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parsers.markdown_blocks(_markdown(spark, sf_dir))
    return chunking.source_map(chunking.parent_child(blocks))


@query()
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    kinds = F.transform("pieces", lambda p: p["type"])
    own = chunks.withColumns({"heading_only": F.forall(kinds, lambda t: t.isin("TITLE", "HEADING")), "has_code": F.array_contains(kinds, "CODE"), "mapped": F.exists("pieces", lambda p: F.coalesce(p["start"] >= 0, F.lit(False)))})
    return quality.chunk_quality(own)


@query(r"""
WITH b AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t, ' ') <> ''),
a AS (SELECT doc_id AS document_id, count(*) AS blocks, CAST(sum(length(t)) + 2 * (count(*) - 1) AS BIGINT) AS characters, CAST(sum(length(regexp_replace(t, '[\s\x{a0}]', '', 'g'))) AS BIGINT) AS non_space,
  count(*) FILTER (length(t) >= 24) AS long_blocks, count(DISTINCT CASE WHEN length(t) >= 24 THEN t END) AS distinct_long, max(length(t)) AS largest FROM b GROUP BY doc_id)
SELECT document_id, blocks, characters, non_space, round((long_blocks - distinct_long) / greatest(1, long_blocks), 4) AS duplicate_ratio, largest,
  CAST(100 - CASE WHEN non_space < 20 THEN 80 ELSE 0 END - CASE WHEN (long_blocks - distinct_long) / greatest(1, long_blocks) >= 0.35 THEN 20 ELSE 0 END AS INTEGER) AS score,
  CASE WHEN non_space < 20 THEN 'FAIL' WHEN (long_blocks - distinct_long) / greatest(1, long_blocks) >= 0.35 THEN 'WARNING' ELSE 'PASS' END AS status FROM a""")
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("order_index", "text")).where(F.trim("text") != "")
    out = quality.parse_quality(lines.withColumns({"type": F.lit("PARAGRAPH"), "page": F.lit(None).cast("int")}))
    return out.select("document_id", "blocks", "characters", "non_space", "duplicate_ratio", "largest", "score", "status")


@query("""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'docx' WHEN page_id % 5 = 2 THEN 'markdown' WHEN page_id % 5 = 3 THEN 'html' ELSE NULL END AS format FROM pages""")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.when(n == 0, "%PDF-1.7").when(n == 1, "PK\x03\x04 word/document.xml").otherwise(F.substring("html", 1, 20)).alias("head"), F.when(n == 2, "notes.MD").when(n == 3, "x.bin").otherwise("x").alias("name"), F.when(n == 3, "text/html; charset=utf-8").alias("content_type")
    )
    return p.select("page_id", parsers.detect_format(F.col("head"), F.col("name"), F.col("content_type")).alias("format"))


@query("""
WITH c AS (SELECT l_orderkey AS sheet, l_linenumber + l_partkey % 3 AS row, l_suppkey % 4 AS col FROM lineitem),
r AS (SELECT DISTINCT sheet, row FROM c), g AS (SELECT sheet, row, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS g FROM r)
SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY min(row)) AS region, min(row) AS first_row, max(row) AS last_row FROM g GROUP BY sheet, g""")
def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sheet", "l_linenumber + l_partkey % 3 AS row", "l_suppkey % 4 AS col", "CAST(l_quantity AS STRING) AS value").dropDuplicates(["sheet", "row", "col"])
    return parsers.sheet_regions(cells).select("sheet", "region", "first_row", "last_row")


@query()
def diversified_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied choice of users' questions, whole, by length and character pairs."""
    q = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    pairs = text.pairs_of(text.comparison_text(F.col("text")))
    q = q.select(F.concat(F.lit("g"), F.col("conv_id") % 20).alias("group_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), (F.length("text") % 4).alias("kind"), pairs.alias("pairs"), (F.col("turn") % 3).cast("int").alias("documents"), (F.length("text") / 100.0).alias("quality"))
    return packing.diversify(q, 5)


@query(r"""
WITH u AS (SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(text, '["''“”‘’]', ' ', 'g'), '\s+', ' ', 'g'), ' '), ' ') AS u FROM conversations WHERE role = 'user' AND text IS NOT NULL AND trim(regexp_replace(regexp_replace(text, '["''“”‘’]', ' ', 'g'), '\s+', ' ', 'g'), ' ') <> ''),
k AS (SELECT *, list_filter(u, lambda x: x NOT IN ('the', 'of', 'and'))[1:4] AS k FROM u WHERE NOT list_contains(list_transform(u, lambda x: upper(x)), 'OR'))
SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN u[1] ELSE array_to_string(k, ' ') END AS plan FROM k""")
def keyword_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as keyword queries of four units at most (turns that hold the word OR aside, which tests hold to)."""
    from corvane.functions.planning import keyword_query

    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    plain = ~F.exists(F.split("text", r"\s+"), lambda w: F.upper(F.regexp_replace(w, "[\"'“”‘’]", "")) == "OR")
    return c.where(plain).select("conv_id", "turn", keyword_query(F.col("text"), F.lit(None).cast("string"), ["the", "of", "and"]).alias("plan")).where("plan IS NOT NULL")
