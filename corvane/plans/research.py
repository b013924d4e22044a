"""Multi-goal research and corpus preparation over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import fusion, ingest, search
from corvane.operators.packing import fit_in_order
from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, chunks, questions, table
from corvane.plans.retrieval import SQL_DEEP, SQL_TERM_SEARCH, SQL_TRIGRAM_SEARCH, _deep


@query("""
WITH c AS (SELECT l_orderkey % 100 AS run_id, l_linenumber % 3 AS goal_id, l_partkey % 60 AS chunk_id, l_partkey % 60 % 25 AS document_id, min(l_suppkey % 60 + 1) AS rrf_rank, max(l_quantity) AS rerank FROM lineitem GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY run_id, goal_id ORDER BY n) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, goal_id ORDER BY rerank DESC, rrf_rank, chunk_id) AS n FROM c QUALIFY row_number() OVER (PARTITION BY run_id, goal_id, document_id ORDER BY rerank DESC, rrf_rank, chunk_id) = 1)),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run_id, document_id ORDER BY place, goal_id) = 1)
SELECT run_id, goal_id, document_id, chunk_id, row_number() OVER (PARTITION BY run_id ORDER BY place, goal_id, chunk_id) AS position FROM u QUALIFY position <= 40""")
def goal_balanced_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older balance of goals: best chunk of a document, first goal of a document, one goal after the other."""
    from corvane.operators.ranking import distinct_on

    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 100 AS run_id", "CAST(l_linenumber % 3 AS BIGINT) AS goal_id", "l_partkey % 60 AS chunk_id", "l_partkey % 60 % 25 AS document_id", "l_suppkey % 60 + 1 AS r", "l_quantity AS q")
    c = c.groupBy("run_id", "goal_id", "chunk_id", "document_id").agg(F.min("r").alias("rrf_rank"), F.max("q").alias("rerank"))
    order = [F.desc("rerank"), "rrf_rank", "chunk_id"]
    best = distinct_on(c, ["run_id", "goal_id", "document_id"], order)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "goal_id").orderBy(*order)))
    once = distinct_on(best, ["run_id", "document_id"], ["place", "goal_id"])
    out = once.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("place", "goal_id", "chunk_id")))
    return out.where("position <= 40").select("run_id", "goal_id", "document_id", "chunk_id", "position")


@query("SELECT p_partkey, rank FROM (SELECT l_partkey AS p_partkey, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey) WHERE rank <= 100")
def global_document_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents that rank first over all: a top-k before the rank, so that no task sees every row."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    top = g.orderBy(F.desc("q"), "p_partkey").limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("q"), "p_partkey")).alias("rank"))


@query("SELECT conv_id, role, arg_max(turn, turn) AS turn, arg_max(length(text), turn) AS n_chars FROM conversations GROUP BY conv_id, role")
def latest_role_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.max_by(F.length("text"), "turn").alias("n_chars"))


@query("""WITH h AS (SELECT user_id AS query_id, value, event_id, event_id % 40 AS chunk_id FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY event_id) AS n FROM h QUALIFY n = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS rank FROM f""")
def first_seen_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", (F.col("event_id") % 40).alias("chunk_id"))
    return fusion.first_ranks(h, ["event_id"]).select("query_id", "chunk_id", "rank")


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id FROM lineitem WHERE l_quantity > 30), k AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id FROM lineitem WHERE l_quantity <= 30)
SELECT * FROM s UNION ALL SELECT * FROM k WHERE query_id NOT IN (SELECT query_id FROM s)""")
def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic hits, and keyword hits for the queries without any."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda c: l.where(c).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"))
    return search.with_fallback(pick("l_quantity > 30"), pick("l_quantity <= 30"))


@query(SQL_DEEP + """, p AS (SELECT query_id, chunk_id, rrf_rank AS rank, CASE WHEN chunk_id % 9 = 0 THEN NULL ELSE chunk_id % 12 END AS parent_id FROM d),
firsts AS (SELECT * FROM p WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1)
SELECT query_id, parent_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS parent_rank FROM firsts QUALIFY parent_rank <= 5""")
def parent_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _deep(spark, sf_dir).select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"), F.when(F.col("chunk_id") % 9 != 0, F.col("chunk_id") % 12).alias("parent_id"))
    return fusion.select_parents(p, 5).select("query_id", "parent_id", "chunk_id", "parent_rank")


@query("""WITH q AS (SELECT doc_id, text, substr(text, 10, 30) AS quote, 9 AS pos FROM documents WHERE length(text) > 60), s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN quote || '#' ELSE quote END AS quote, pos, text FROM q)
SELECT doc_id, sha256(doc_id || chr(31) || pos || chr(31) || quote) AS evidence_id FROM s WHERE substr(text, pos + 1, length(quote)) = quote AND doc_id IN (SELECT doc_id FROM labels)""")
def evidence_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that stand word for word at their place and belong to a search that really found them."""
    q = table(spark, sf_dir, "documents").where(F.length("text") > 60).select("doc_id", "text", F.lit(9).alias("at"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("text", 10, 30), F.lit("#"))).otherwise(F.substring("text", 10, 30)).alias("quote"))
    real = q.where(F.expr("substring(text, at + 1, length(quote)) = quote")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return real.select("doc_id", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("at").cast("string"), "quote").cast("binary"), 256).alias("evidence_id"))


@query("""
WITH RECURSIVE e AS (SELECT l_orderkey % 200 AS run_id, l_linenumber AS goal, l_partkey AS item, l_suppkey % 90 + 40 AS tokens,
  row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_linenumber, l_discount DESC, l_partkey, l_suppkey % 90) AS n FROM lineitem),
w(run_id, n, room, taken, "position") AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST(1500 AS BIGINT), false, CAST(0 AS BIGINT) FROM e
  UNION ALL
  SELECT e.run_id, e.n, CASE WHEN tokens <= room THEN room - tokens ELSE room END, tokens <= room, CASE WHEN tokens <= room THEN "position" + 1 ELSE "position" END FROM w JOIN e ON e.run_id = w.run_id AND e.n = w.n + 1)
SELECT run_id, "position", goal, item FROM w JOIN e USING (run_id, n) WHERE taken""")
def judge_bounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's evidence for its judge: goal by goal, best first, what fits the tokens that are left over all goals."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("run_id"), F.col("l_linenumber").alias("goal"), F.col("l_discount").alias("score"), F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 90 + 40).cast("long").alias("tokens"))
    taken = fit_in_order(e, "run_id", ["goal", F.desc("score"), "item", "tokens"], 1500)
    return taken.select("run_id", "position", "goal", "item")


@query("""WITH s AS (SELECT l_orderkey AS chunk_id, l_linenumber AS ord, CASE WHEN l_tax < 0.05 THEN l_partkey END AS a, CASE WHEN l_tax < 0.05 THEN l_partkey + CAST(l_quantity AS BIGINT) END AS b, l_suppkey % 30 AS page FROM lineitem)
SELECT chunk_id, arg_min(page, (ord, page)) AS page, coalesce(arg_min(a, (ord, a)) FILTER (a IS NOT NULL), -1) AS source_start, coalesce(arg_max(b, (ord, b)) FILTER (b IS NOT NULL), -1) AS source_end FROM s GROUP BY chunk_id""")
def source_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chunk stands: its first segment's page, first mapped start and last mapped end, in one aggregate."""
    mapped = F.col("l_tax") < 0.05
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"), F.when(mapped, F.col("l_partkey")).alias("a"), F.when(mapped, F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("b"), (F.col("l_suppkey") % 30).alias("page"))
    return s.groupBy("chunk_id").agg(F.min_by("page", F.struct("ord", "page")).alias("page"), F.coalesce(F.min_by("a", F.when(F.col("a").isNotNull(), F.struct("ord", "a"))), F.lit(-1)).alias("source_start"), F.coalesce(F.max_by("b", F.when(F.col("b").isNotNull(), F.struct("ord", "b"))), F.lit(-1)).alias("source_end"))


@query("SELECT l_orderkey, list_sort(list_distinct(list_concat(list(DISTINCT 'k' || l_linenumber % 3), list(DISTINCT 's' || l_suppkey % 2)))) AS sources FROM lineitem GROUP BY l_orderkey")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p, c: F.sort_array(F.collect_set(F.concat(F.lit(p), c.cast("string"))))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tag("k", F.col("l_linenumber") % 3).alias("a"), tag("s", F.col("l_suppkey") % 2).alias("b"))  # noqa: E741
    return l.select("l_orderkey", F.sort_array(text.merge_sources(F.col("a"), F.col("b"))).alias("sources"))


@query("""SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents GROUP BY source, lang""")
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a data set must keep: documents by format, declared lengths, unique ids."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated_ids"))


@query("""WITH a AS (SELECT sha256(text) AS h, doc_id % 3 AS parser, doc_id FROM documents WHERE doc_id % 2 = 0), w AS (SELECT sha256(text) AS h, doc_id % 3 AS parser, doc_id FROM documents WHERE doc_id % 2 = 1)
SELECT w.doc_id, arg_max(a.doc_id, a.doc_id) AS artifact FROM w JOIN a USING (h, parser) GROUP BY w.doc_id""")
def artifact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest parsed artifact of the same content and parser, for documents that have none; donors are one row for each content first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), (F.col("doc_id") % 3).alias("parser"))
    a = ingest.newest(d.where("doc_id % 2 = 0"), ["h", "parser"], [F.desc("doc_id")]).withColumnRenamed("doc_id", "artifact")
    return d.where("doc_id % 2 = 1").join(a, ["h", "parser"]).select("doc_id", "artifact")


@query("""WITH s AS (SELECT event_id AS query_id, user_id AS chunk_id, event_id % 2 AS generation, value AS score FROM events), m AS (SELECT query_id % 50 AS query_id, chunk_id, max(score) AS score FROM s GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m QUALIFY rank <= 5""")
def generation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several index generations merged by the best score of each chunk."""
    s = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("query_id"), F.col("user_id").alias("chunk_id"), F.col("value").alias("score"))
    return search.top_k(s.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), 5, [F.desc("score"), "chunk_id"]).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS dup FROM documents), g AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS depth FROM d WHERE dup = 1)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY depth, source) AS line FROM g) WHERE line <= 100""")
def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents dealt evenly from the sources, the longest first, one of those with one text."""
    from corvane.operators.ranking import distinct_on, interleave

    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("start"))
    once = distinct_on(d, ["start"], [F.desc("n_chars"), "doc_id"])
    return interleave(once, ["source"], [F.desc("n_chars"), "doc_id"], 100).select("doc_id", "source")


@query(r"""SELECT doc_id, length(regexp_replace(lower(regexp_replace(text, '[^0-9a-zA-Z一-鿿]+', '', 'g')), '^[0-9]+', '')) AS compared, len(regexp_extract_all(text, '[一-鿿]')) AS cjk FROM documents WHERE text IS NOT NULL""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    compared = F.regexp_replace(text.comparison_text(F.regexp_replace(t, "[^0-9a-zA-Z一-鿿]+", "")), "^[0-9]+", "")
    return table(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", F.length(compared).alias("compared"), text.ideographs(t).alias("cjk"))


@query()
def markdown_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as Markdown and cleaned, whole (tests hold the cleaning against a scanner written out in Python)."""
    from corvane.sources.cleaning import clean_markdown

    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    t = F.concat(F.lit("---\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\n---\n<!-- c -->"), F.col("text"), F.lit(" [link](http://x) <b>bold</b> ![pic](a.png)\n```\n<!-- kept -->\n```"))
    return d.select("doc_id", F.length(clean_markdown(t)).alias("n"))


@query(f"""WITH c AS ({SQL_CHUNKS}), e AS (SELECT document_id, min(chunk_id) AS chunk_id FROM c WHERE length(text) >= 100 GROUP BY document_id, sha256(text))
SELECT document_id, count(*) AS n FROM e GROUP BY document_id""")
def evidence_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence blocks of documents: long enough lines."""
    c = chunks(spark, sf_dir).where(F.length("text") >= 100).groupBy("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("chunk_id").alias("c"))
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN attempts < 10 THEN 'PUBLISHED' ELSE 'FAILED' END AS state, least(attempts, 10) AS attempts FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 15 ELSE 0 END AS attempts FROM events)""")
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox read as a stream: rows are published, and those that failed ten times are given up."""
    from corvane.streaming import jobs

    e = jobs.events(spark, f"{sf_dir}/events.parquet")
    attempts = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k").cast("int") % 15).otherwise(0)
    out = e.withColumn("a", attempts).select("event_id", F.when(F.col("a") < 10, "PUBLISHED").otherwise("FAILED").alias("state"), F.least("a", F.lit(10)).alias("attempts"))
    return jobs.finish(out, jobs.workspace(spark))


@query(f"""WITH c AS ({SQL_CHUNKS}) SELECT chunk_id, document_id FROM c WHERE document_id = 12 OR kb = 'src3' OR chunk_id = 700000 ORDER BY document_id, line_no LIMIT 50 OFFSET 20""")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document, a knowledge base or by id, a page of fifty at most."""
    c = chunks(spark, sf_dir)
    return c.where("document_id = 12 OR kb = 'src3' OR chunk_id = 700000").orderBy("document_id", "line_no").offset(20).limit(50).select("chunk_id", "document_id")


#: Each minimal cover's start and end by the last places of a query's terms before each place.
SQL_DENSITY = r"""
wq AS (SELECT query_id, unnest(t) AS term, len(t) AS n FROM q), full_hold AS (SELECT query_id, chunk_id, n FROM wq JOIN ct USING (term) GROUP BY query_id, chunk_id, n HAVING count(*) = n),
spots AS (SELECT h.query_id, h.chunk_id, h.n, x.term, x.pos FROM full_hold h JOIN (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM c)) x USING (chunk_id)
  JOIN wq ON wq.query_id = h.query_id AND wq.term = x.term),
lasts AS (SELECT a.query_id, a.chunk_id, a.n, a.pos, b.term, max(b.pos) AS last FROM spots a JOIN spots b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
covers AS (SELECT query_id, chunk_id, pos, min(last) AS start FROM lasts GROUP BY query_id, chunk_id, n, pos HAVING count(*) = n),
density AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (pos - start + 1)) AS density FROM (SELECT query_id, chunk_id, start, min(pos) AS pos FROM covers GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {SQL_TERM_SEARCH}, {SQL_TRIGRAM_SEARCH}, {SQL_DENSITY},
s AS (SELECT query_id, chunk_id, coalesce(density, 0) + 0.2::DOUBLE * coalesce(ts.score, 0) AS score FROM ts FULL JOIN density d USING (query_id, chunk_id) WHERE density IS NOT NULL OR ts.score > 0.03)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 30""")
def keyword_search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's chunks by cover density plus a fifth of the trigram similarity; either alone lets a chunk in."""
    return search.keyword_search(questions(spark, sf_dir), chunks(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page, l_returnflag || ' page ' || l_linenumber AS text FROM lineitem), n AS (SELECT document_id, page, trim(regexp_replace(lower(text), '\\d+', '#', 'g')) AS norm FROM p),
c AS (SELECT document_id, count(DISTINCT page) AS pages FROM p GROUP BY document_id)
SELECT document_id, norm, count(DISTINCT page) AS on_pages FROM n JOIN c USING (document_id) GROUP BY document_id, norm, pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages / 2))""")
def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat on at least two pages and half of all: headers and footers."""
    from corvane.sources.parsers import repeated_margins

    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", F.lit(" page "), F.col("l_linenumber").cast("string")).alias("text"))
    return repeated_margins(p.distinct())


@query("""WITH e AS (SELECT l_orderkey AS case_id, l_partkey AS d FROM lineitem WHERE l_quantity > 35), f AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS d FROM lineitem WHERE l_discount > 0.03), r AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS d FROM lineitem WHERE l_discount > 0.06)
SELECT case_id, round(count(f.d) / count(*), 6) AS discovery, round(count(r.d) / count(*), 6) AS deep_read, count(r.d) = count(*) AS compliant FROM (SELECT DISTINCT * FROM e) e LEFT JOIN f USING (case_id, d) LEFT JOIN r USING (case_id, d) GROUP BY case_id""")
def strict_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a case's expected documents were found, and how many of them read."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda c: l.where(c).select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("d")).distinct()
    e = pick("l_quantity > 35").join(pick("l_discount > 0.03D").withColumn("f", F.lit(1)), ["case_id", "d"], "left").join(pick("l_discount > 0.06D").withColumn("r", F.lit(1)), ["case_id", "d"], "left")
    n = F.count(F.lit(1))
    return e.groupBy("case_id").agg(F.round(F.count("f") / n, 6).alias("discovery"), F.round(F.count("r") / n, 6).alias("deep_read"), (F.count("r") == n).alias("compliant"))


@query("SELECT o_custkey AS run_id, count(*) AS citations, round(count(*) FILTER (p_size > 10) / count(*), 6) AS resolvable FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey")
def citation_resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a run's citations that lead to what they cite."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run_id"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 10).alias("ok"))
    x = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").join(p, "l_partkey")
    return x.groupBy("run_id").agg(F.count(F.lit(1)).alias("citations"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("resolvable"))


@query()
def trimmed_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs over their budget, trimmed from the end while other items cover what goes."""
    from corvane.operators.packing import trim_packs

    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS run_id", "l_linenumber % 3 AS goal_id", "l_suppkey % 4 AS requirement_id", "l_partkey % 30 AS parent_id", "l_discount AS score", "CAST(100 + l_partkey % 30 * 7 AS BIGINT) AS tokens")
    return trim_packs(e, 1200)


@query("""WITH l AS (SELECT l_orderkey // 4 AS case_id, l_suppkey % 20 AS d, l_orderkey AS o, l_linenumber AS i, l_partkey AS p, l_quantity AS q, l_discount AS x FROM lineitem),
g AS (SELECT case_id, list(d) FILTER (q > 35) AS e, coalesce(list(d ORDER BY o, i, p, d) FILTER (x > 0.01), []) AS f, list(d) FILTER (x > 0.06) AS r FROM l GROUP BY case_id),
n AS (SELECT case_id, len(coalesce(e, [])) AS n, len(list_filter(e, lambda y: list_contains(f, y))) AS a, len(list_filter(e, lambda y: list_contains(f[1:5], y))) AS a5, len(list_filter(e, lambda y: list_contains(f[1:10], y))) AS a10,
  r IS NOT NULL AS has_read, len(list_filter(e, lambda y: list_contains(r, y))) AS b FROM g)
SELECT case_id, CASE WHEN n = 0 THEN 0 ELSE round(a / n, 6) END AS all_recall, CASE WHEN n = 0 THEN 0 ELSE round(a5 / n, 6) END AS discovery5, CASE WHEN n = 0 THEN 0 ELSE round(a10 / n, 6) END AS discovery10,
  CASE WHEN has_read THEN CASE WHEN n = 0 THEN 0 ELSE round(b / n, 6) END END AS deep_read, CASE WHEN has_read THEN 1.0 END AS compliant FROM n""")
def strict_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected documents among the first five, ten and all that a run found, in order, and among those it read."""
    from corvane.operators import metrics

    l = table(spark, sf_dir, "lineitem").withColumns({"case_id": F.expr("l_orderkey div 4"), "d": F.col("l_suppkey") % 20})  # noqa: E741
    some = lambda c: F.collect_list(F.when(c, F.col("d")))
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_discount") > 0.01, F.struct("l_orderkey", "l_linenumber", "l_partkey", "d")))), lambda s: s["d"])
    g = l.groupBy("case_id").agg(some(F.col("l_quantity") > 35).alias("e"), found.alias("f"), some(F.col("l_discount") > 0.06).alias("r"))
    m = metrics.strict_measures(F.col("e"), F.col("f"), F.when(F.size("r") > 0, F.col("r")))
    return g.select("case_id", *[F.round(c, 6).alias(k) for k, c in m.items()])


@query("""WITH b AS (SELECT doc_id AS block_id, doc_id % 5 AS order_index, CASE WHEN doc_id % 8 <> 0 THEN doc_id % 30 END AS page, CASE WHEN doc_id % 6 <> 0 THEN doc_id * 10 END AS s, doc_id * 10 + length(text) AS e, text FROM documents),
c AS (SELECT doc_id AS chunk_id, substr(text, 5 + doc_id % 20, 80) || CASE WHEN doc_id % 3 = 1 THEN '#' ELSE '' END AS t FROM documents WHERE length(text) > 40),
m AS (SELECT chunk_id, chunk_id + 1 AS first_block, CASE WHEN chunk_id % 2 = 0 THEN chunk_id END AS s, chunk_id + 9 AS e FROM c WHERE chunk_id % 3 = 2),
x AS (SELECT chunk_id, t, b.*, strpos(b.text, t) AS pos FROM c JOIN b ON b.block_id IN (c.chunk_id, c.chunk_id + 1)),
f AS (SELECT chunk_id, arg_min(struct_pack(v := page), (order_index, block_id)) FILTER (pos > 0) AS p2, min(struct_pack(o := order_index, b := block_id, v := s + pos - 1)) FILTER (pos > 0 AND s IS NOT NULL) AS s2, min(page) AS p3, min(s) AS s3, max(e) AS e3 FROM x GROUP BY chunk_id)
SELECT c.chunk_id, coalesce(mb.page, p2.v, p3) AS page, coalesce(m.s, s2.v, s3) AS source_start, coalesce(m.e, s2.v + length(t), e3) AS source_end
FROM c LEFT JOIN m USING (chunk_id) LEFT JOIN b mb ON mb.block_id = m.first_block LEFT JOIN f USING (chunk_id)""")
def located_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents placed by their segments, by their text in a block, or by the blocks' bounds."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    b = d.select(i.alias("block_id"), (i % 5).alias("order_index"), F.when(i % 8 != 0, i % 30).alias("page"), F.when(i % 6 != 0, i * 10).alias("source_start"), (i * 10 + F.length("text")).alias("source_end"), "text")
    c = d.where(F.length("text") > 40).select(i.alias("chunk_id"), F.concat(F.expr("substring(text, 5 + doc_id % 20, 80)"), F.when(i % 3 == 1, "#").otherwise("")).alias("text"), F.array(i, i + 1).alias("block_ids"))
    k = F.col("chunk_id")
    s = c.where(k % 3 == 2).select("chunk_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    s = s.select("chunk_id", "ord", (k + 1 - F.col("ord")).alias("block_id"), F.when((F.col("ord") == 1) & (k % 2 == 0), k).alias("source_start"), (k + 8 + F.col("ord")).alias("source_end"))
    return ingest.source_locations(c, b, s)
