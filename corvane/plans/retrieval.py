"""Search, fusion, packing and balanced rankings over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import fusion, metrics, packing, ranking, search
from corvane.operators.keyword_index import KeywordIndex
from corvane.operators.vector_index import VectorIndex, search_generations
from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, SQL_GOLD, chunks, gold, questions, table

SQL_TERMS = r"list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+')), lambda w: w <> '')"
SQL_TERM_SEARCH = f"""
c AS ({SQL_CHUNKS}),
q AS (SELECT item_id AS query_id, {SQL_TERMS.format('text')} AS t FROM benchmark),
qt AS (SELECT query_id, unnest(t) AS term, len(t) AS n FROM q), ct AS (SELECT DISTINCT chunk_id, unnest({SQL_TERMS.format('text')}) AS term FROM c),
ks AS (SELECT query_id, chunk_id, count(*) / n AS score FROM qt JOIN ct USING (term) GROUP BY query_id, chunk_id, n),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ks QUALIFY rank <= 30)"""
SQL_TRI = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SQL_TRIGRAM_SEARCH = f"""
q3 AS (SELECT item_id AS query_id, {SQL_TRI.format('text')} AS t FROM benchmark), c3 AS (SELECT chunk_id, {SQL_TRI.format('text')} AS t FROM c),
q3t AS (SELECT query_id, unnest(t) AS g, len(t) AS n FROM q3), c3t AS (SELECT chunk_id, unnest(t) AS g, len(t) AS n FROM c3),
ts AS (SELECT query_id, chunk_id, count(*) / (a.n + b.n - count(*)) AS score FROM q3t a JOIN c3t b USING (g) GROUP BY query_id, chunk_id, a.n, b.n),
trigram AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts WHERE score > 0.03 QUALIFY rank <= 30)"""
SQL_FUSED = """
hits AS (SELECT query_id, 0 AS list_idx, rank, chunk_id, score FROM keyword UNION ALL SELECT query_id, 1, rank, chunk_id, score FROM trigram),
rrf AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((list_idx, rank)) AS seen FROM hits GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen, chunk_id) AS rrf_rank FROM rrf QUALIFY rrf_rank <= 40)"""


def hybrid_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    return search.term_search(asked, own), search.trigram_search(asked, own)


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword, trigram = hybrid_hits(spark, sf_dir)
    both = keyword.withColumn("list_idx", F.lit(0)).unionByName(trigram.withColumn("list_idx", F.lit(1)))
    return fusion.fuse_fast(both, limit=40)


@query(f"WITH {SQL_TERM_SEARCH} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM keyword")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.term_search(questions(spark, sf_dir), chunks(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {SQL_TERM_SEARCH} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM keyword")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search by an index that is written, opened and read in blocks whose bounds allow a hit."""
    written = KeywordIndex.build(chunks(spark, sf_dir))
    hits = KeywordIndex.open(spark, written.path).search(questions(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


SQL_BM25 = f"""c AS ({SQL_CHUNKS}), w AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM c),
s AS (SELECT count(*) AS chunks, (SELECT avg(len(t)) FROM w JOIN c USING (chunk_id) WHERE document_id % 10 <> 7) AS mean FROM w),
tf AS (SELECT chunk_id, term, count(*) AS f, n FROM (SELECT chunk_id, unnest(t) AS term, len(t) AS n FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
k AS (SELECT query_id, chunk_id, round(sum(ln(1 + (chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s WHERE term <> '' GROUP BY ALL)"""


@query(f"WITH {SQL_BM25} SELECT query_id, chunk_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k QUALIFY rank <= 20")
def keyword_index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index to which a tenth of the documents is appended after the rest was written."""
    own = chunks(spark, sf_dir)
    index = KeywordIndex.build(own.where("document_id % 10 <> 7"), scoring="bm25").append(own.where("document_id % 10 = 7"))
    return index.search(questions(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH c AS ({SQL_CHUNKS}), {SQL_TRIGRAM_SEARCH} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM trigram")
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.trigram_search(questions(spark, sf_dir), chunks(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


#: Components of a vector in ``embeddings``.
WIDTH = 64
SQL_VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""
WITH {SQL_VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors of a stated query set: the ids divisible by 100."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return search.vector_search(q, v).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
WITH {SQL_VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def vector_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return search.vector_search(q, v, 5, within=["label"]).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
WITH {SQL_VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors by an index that is written, opened and read in rings that the triangle inequality leaves."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    written = VectorIndex.build(v, WIDTH)
    hits = VectorIndex.open(spark, written.path).search(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
WITH {SQL_VECTORS}, g AS (SELECT vec_id, label, e, 0 AS generation FROM v WHERE vec_id % 3 <> 1 UNION ALL SELECT vec_id, label, list_transform(e, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END), 1 FROM v WHERE vec_id % 3 <> 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(round(list_cosine_similarity(CASE WHEN generation = 0 THEN a.e ELSE list_transform(a.e, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END) END, b.e), 9)) AS s
  FROM v a JOIN g b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 8""")
def vector_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of an index whose models differ (the later one reads half of the components), merged; searches stay within a label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    other = v.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float"))))
    asked = []
    for vectors, kept in ((v, "vec_id % 3 <> 1"), (other, "vec_id % 3 <> 0")):
        index = VectorIndex.build(vectors.where(kept), WIDTH, within=["label"], ring=64)
        asked.append((index, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")))
    hits = search_generations(asked, 8, over_fetch=2)
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {SQL_TERM_SEARCH}, {SQL_TRIGRAM_SEARCH}, {SQL_FUSED} SELECT query_id, chunk_id, round(rrf, 9) AS rrf, rrf_rank FROM fused")
def rrf_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "rrf_rank")


SQL_DEEP = f"""WITH h AS (SELECT l_orderkey % 200 AS query_id, l_linenumber % 3 AS list_idx, l_partkey % 40 AS chunk_id, min(l_suppkey) AS rank, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_idx ORDER BY rank, chunk_id) AS r FROM h),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS rrf, min(r) AS best_rank, max(score) AS best_score, list_sort(list(DISTINCT list_idx)) AS routes FROM u GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, best_rank, best_score DESC, chunk_id) AS rrf_rank FROM f)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 200 AS query_id", "l_linenumber % 3 AS list_idx", "l_partkey % 40 AS chunk_id", "l_suppkey", "l_quantity")
    return x.groupBy("query_id", "list_idx", "chunk_id").agg(F.min("l_suppkey").alias("rank"), F.max("l_quantity").cast("double").alias("score"))


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fusion.fuse_deep(_lists(spark, sf_dir))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "best_rank", F.desc("best_score"), "chunk_id")
    return d.withColumn("rrf_rank", F.row_number().over(w))


@query(SQL_DEEP + " SELECT query_id, chunk_id, round(rrf, 9) AS rrf, best_rank, best_score, rrf_rank FROM d WHERE rrf_rank <= 20")
def rrf_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir).where("rrf_rank <= 20").select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "best_rank", "best_score", "rrf_rank")


@query(SQL_DEEP + """, p AS (SELECT *, CASE WHEN list_contains(routes, 0) AND rrf_rank = min(CASE WHEN list_contains(routes, 0) THEN rrf_rank END) OVER (PARTITION BY query_id) THEN 0
  WHEN list_contains(routes, 1) AND rrf_rank = min(CASE WHEN list_contains(routes, 1) THEN rrf_rank END) OVER (PARTITION BY query_id) THEN 1 ELSE 2 END AS pin FROM d)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pin, rrf_rank) AS final_rank FROM p QUALIFY final_rank <= 6""")
def route_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.protect_routes(_deep(spark, sf_dir).withColumnRenamed("rrf_rank", "rank"), 6)
    return out.select("query_id", "chunk_id", "final_rank")


@query(f"""WITH {SQL_TERM_SEARCH}, k AS (SELECT keyword.*, c.parent_id FROM keyword JOIN c USING (chunk_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM k QUALIFY n = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS group_rank FROM f QUALIFY group_rank <= 8)
SELECT query_id, group_rank, g.parent_id, g.chunk_id, length(coalesce(p.text, own.text)) AS n_chars FROM g JOIN c own ON own.chunk_id = g.chunk_id LEFT JOIN c p ON p.chunk_id = g.parent_id""")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir)
    hits = search.term_search(questions(spark, sf_dir), own).join(own.select("chunk_id", "parent_id", "text"), "chunk_id")
    out = fusion.expand_parents(hits, own)
    return out.select("query_id", "group_rank", F.col("group_id").alias("parent_id"), "chunk_id", F.length("text").alias("n_chars"))


@query(f"""WITH {SQL_TERM_SEARCH}, k AS (SELECT keyword.*, c.parent_id FROM keyword JOIN c USING (chunk_id))
SELECT query_id, parent_id, arg_min(chunk_id, (-score, rank)) AS anchor_chunk_id FROM k GROUP BY ALL""")
def citation_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).select("chunk_id", "parent_id")
    return fusion.citation_anchors(search.term_search(questions(spark, sf_dir), chunks(spark, sf_dir)).join(own, "chunk_id"))


@query()
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits packed under a budget of 300 tokens (an order-dependent fold: tests hold it against a loop)."""
    own = chunks(spark, sf_dir)
    hits = search.term_search(questions(spark, sf_dir), own).join(own.select("chunk_id", "text"), "chunk_id")
    return packing.pack_in_order(hits, 300).select("query_id", "evidence", "chunk_id", "tokens")


@query(f"""WITH {SQL_TERM_SEARCH}, {SQL_TRIGRAM_SEARCH}, {SQL_FUSED}
SELECT coalesce(k.query_id, t.query_id, f.query_id) AS query_id, coalesce(k.chunk_id, t.chunk_id, f.chunk_id) AS chunk_id, k.rank AS keyword_rank, t.rank AS semantic_rank, f.rrf_rank, coalesce(f.rrf_rank <= 8, false) AS accepted
FROM keyword k FULL JOIN trigram t ON k.query_id = t.query_id AND k.chunk_id = t.chunk_id
FULL JOIN fused f ON f.query_id = coalesce(k.query_id, t.query_id) AND f.chunk_id = coalesce(k.chunk_id, t.chunk_id)""")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword, trigram = hybrid_hits(spark, sf_dir)
    fused = fused_hits(spark, sf_dir)
    return fusion.trace(keyword, trigram, fused, fused.where("rrf_rank <= 8")).select("query_id", "chunk_id", "keyword_rank", "semantic_rank", "rrf_rank", "accepted")


@query(f"""WITH {SQL_TERM_SEARCH}, t AS (SELECT q.query_id, c.chunk_id, k.score, len(list_intersect(q.t, {SQL_TERMS.format('c.text')})) / len(q.t) AS overlap FROM keyword k JOIN q USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, round(overlap + score, 6) AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY round(overlap + score, 9) DESC, chunk_id) AS rank FROM t WHERE overlap + score >= 0.05 QUALIFY rank <= 12""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits by term overlap plus their score, above the least rerank score."""
    own, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    hits = search.term_search(asked, own).join(own.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").join(asked.select("query_id", F.col("text").alias("q")), "query_id")
    out = hits.withColumn("rerank", text.term_overlap(F.col("q"), F.col("chunk_text")) + F.col("score")).where("rerank >= 0.05").drop("rank")
    return search.top_k(out, 12, [F.desc(F.round("rerank", 9)), "chunk_id"]).select("query_id", "chunk_id", F.round("rerank", 6).alias("rerank"), "rank")


@query("""
WITH c AS (SELECT l_orderkey % 100 AS run_id, l_linenumber % 3 AS goal_id, l_linenumber % 3 AS goal_order, l_partkey % 60 AS chunk_id, l_partkey % 60 % 25 AS document_id,
  CASE WHEN l_tax < 0.06 THEN l_suppkey % 60 + 1 END AS rrf_rank, CASE WHEN l_tax < 0.06 THEN l_discount END AS rrf_score, CASE WHEN l_discount < 0.04 THEN l_suppkey % 20 + 1 END AS rerank_rank, CASE WHEN l_discount < 0.04 THEN l_quantity / 50 END AS rerank_score FROM lineitem),
e AS (SELECT l_orderkey % 100 AS run_id, l_linenumber % 3 AS goal_id, l_partkey % 60 % 25 AS document_id, l_suppkey % 4 AS requirement_id, l_returnflag = 'A' AS active FROM lineitem WHERE l_quantity > 45),
k AS (SELECT run_id, goal_id, document_id, bool_or(active) AS has_active, count(DISTINCT CASE WHEN active THEN requirement_id END) AS covered FROM e GROUP BY ALL),
f AS (SELECT c.run_id, c.goal_id, c.chunk_id, c.document_id, min(goal_order) AS goal_order, sum(1.0::DOUBLE / (60.0 + rrf_rank)) AS fusion, min(rerank_rank) AS brr, max(rerank_score) AS brs, max(rrf_score) AS bfs,
  min(least(coalesce(rerank_rank / 12.0::DOUBLE, 999.0), coalesce(rrf_rank / 60.0::DOUBLE, 999.0))) AS normal_rank, coalesce(bool_or(has_active), false) AS has_active, coalesce(max(covered), 0) AS covered
  FROM c LEFT JOIN k USING (run_id, goal_id, document_id) WHERE rerank_rank IS NOT NULL OR rrf_rank IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, goal_id ORDER BY CASE WHEN has_active OR brr <= 12 THEN 0 ELSE 1 END, has_active DESC, round(normal_rank, 9), round(fusion, 12) DESC NULLS LAST, brs DESC NULLS LAST, bfs DESC NULLS LAST, covered DESC, chunk_id) AS chunk_rank FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY run_id, goal_id ORDER BY chunk_rank, document_id) AS document_rank FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, goal_id, document_id ORDER BY chunk_rank) = 1)),
u AS (SELECT *, row_number() OVER (PARTITION BY run_id, goal_id ORDER BY document_rank, document_id) AS balanced_rank FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run_id, document_id ORDER BY document_rank, goal_order, goal_id, chunk_id) = 1))
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY balanced_rank, goal_order, goal_id, chunk_id) AS position, goal_id, document_id, chunk_id, balanced_rank, round(coalesce(brs, fusion, bfs, 0), 6) AS score FROM u QUALIFY position <= 40""")
def goal_balanced_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey % 100 AS run_id", "CAST(l_linenumber % 3 AS BIGINT) AS goal_id"]
    c = x.selectExpr(
        *keys, "l_linenumber % 3 AS goal_order", "l_partkey % 60 AS chunk_id", "l_partkey % 60 % 25 AS document_id", "CASE WHEN l_tax < 0.06D THEN l_suppkey % 60 + 1 END AS rrf_rank", "CASE WHEN l_tax < 0.06D THEN l_discount END AS rrf_score",
        "CASE WHEN l_discount < 0.04D THEN l_suppkey % 20 + 1 END AS rerank_rank", "CASE WHEN l_discount < 0.04D THEN l_quantity / 50 END AS rerank_score",
    )
    e = x.where("l_quantity > 45").selectExpr(*keys, "l_partkey % 60 % 25 AS document_id", "l_suppkey % 4 AS requirement_id", "l_returnflag = 'A' AS active")
    fused = ranking.fuse_phases(c, e).withColumns({"normal_rank": F.round("normal_rank", 9), "fusion": F.round("fusion", 12)})
    return ranking.balance_goals(fused).withColumn("score", F.round("score", 6))


@query("""
SELECT doc_id, source, n, excerpt FROM (SELECT doc_id, source, substr(text, 1, 50) AS excerpt, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3""")
def fair_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source, by their beginnings."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id", "source", "n", F.substring("text", 1, 50).alias("excerpt"))


@query(f"""WITH c AS ({SQL_CHUNKS}) SELECT chunk_id, CASE WHEN regexp_matches(kb, '(?i)src1') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM c WHERE regexp_matches(kb, '(?i)src1') OR regexp_matches(text, '(?i)licen[sc]e')
ORDER BY score DESC, chunk_id LIMIT 100""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(chunks(spark, sf_dir), "licen[sc]e", F.col("kb"), "src1").select("chunk_id", "score")


@query(r"""
WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM w WHERE (contains(t, ' license ') AND contains(t, ' mit ') OR contains(t, ' apache license ')) AND NOT contains(t, ' gnu ')""")
def web_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.where(search.matches_web_query(words, 'license mit or "apache license" -gnu')).select("doc_id")


@query(f"""WITH c AS ({SQL_CHUNKS}), w AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM c),
x AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM w), s AS (SELECT chunk_id, term, pos FROM x WHERE term IN ('the', 'of')),
l AS (SELECT chunk_id, pos, max(CASE WHEN term = 'the' THEN pos END) OVER k AS a, max(CASE WHEN term = 'of' THEN pos END) OVER k AS b FROM s WINDOW k AS (PARTITION BY chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT chunk_id, least(a, b) AS start, min(pos) AS pos FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT chunk_id, round(sum(1.0::DOUBLE / (pos - start + 1)), 6) AS density FROM m GROUP BY chunk_id""")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir)
    return search.cover_density(own, ["the", "of"]).withColumn("density", F.round("density", 6))


@query()
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic hashed embeddings of the benchmark's items."""
    from corvane.functions.embedding import hashed_embedding as embed

    return table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("embedding"))


@query()
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS run_id", "l_linenumber % 3 AS goal_id", "l_suppkey % 4 AS requirement_id", "l_partkey % 30 AS parent_id", "l_discount AS score", "CAST(100 + l_partkey % 30 * 7 AS BIGINT) AS tokens")
    return packing.pack_for_coverage(e, 900)


@query()
def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS run_id", "l_orderkey * 8 + l_linenumber AS seq", "CAST(l_linenumber % 3 AS BIGINT) AS goal_id", "l_partkey % 50 AS span_id", "l_partkey % 10 AS parent_id", "l_returnflag AS phase")
    return packing.accept_within_quotas(e, 40, 16, 4).drop("linked")


@query()
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with spans that support several requirements, each of which takes six spans."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS run_id", "l_orderkey * 8 + l_linenumber AS seq", "CAST(l_linenumber % 3 AS BIGINT) AS goal_id", "l_partkey % 50 AS span_id", "l_partkey % 10 AS parent_id", "l_returnflag AS phase", "array_distinct(array(l_suppkey % 4, l_partkey % 3)) AS requirements")
    return packing.accept_within_quotas(e, 40, 16, 4, 6)


@query("""
WITH c AS (SELECT o_custkey AS query_id, o_orderkey % 5 AS parent_rank, o_orderkey % 17 AS span_id, min(o_orderkey) AS rank FROM orders GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_rank ORDER BY rank, span_id) AS depth FROM c),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, span_id ORDER BY depth, parent_rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY depth, parent_rank) AS position, span_id FROM o QUALIFY position <= 6""")
def parent_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query_id", "o_orderkey % 5 AS parent_rank", "o_orderkey % 17 AS span_id", "o_orderkey")
    return packing.round_robin(c.groupBy("query_id", "parent_rank", "span_id").agg(F.min("o_orderkey").alias("rank")), 6)


@query()
def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import chunking

    docs = table(spark, sf_dir, "documents")
    parents = docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("parent_id"), F.substring("text", 1, 60).alias("focus"), F.substring("text", 100, 50).alias("anchor"))
    return chunking.candidate_spans(parents, asked, limit=120)


@query(f"""
WITH {SQL_TERM_SEARCH}, {SQL_TRIGRAM_SEARCH}, {SQL_FUSED}, gold AS ({SQL_GOLD}),
d AS (SELECT f.query_id AS case_id, c.document_id, min(rrf_rank) AS rank FROM fused f JOIN c USING (chunk_id) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, document_id) AS place FROM d QUALIFY place <= 10),
m AS (SELECT p.*, CASE WHEN g.case_id IS NULL THEN 0 ELSE 1 END AS rel FROM p LEFT JOIN gold g USING (case_id, document_id)),
x AS (SELECT case_id, count(*) FILTER (place <= 5 AND rel = 1) AS m5, count(*) FILTER (rel = 1) AS m10, min(CASE WHEN rel = 1 THEN place END) AS first FROM m GROUP BY case_id),
n AS (SELECT case_id, count(*) AS n FROM gold GROUP BY case_id),
a AS (SELECT b.item_id, coalesce(n.n, 0) AS n, coalesce(m5, 0) AS m5, coalesce(m10, 0) AS m10, first FROM benchmark b LEFT JOIN x ON x.case_id = b.item_id LEFT JOIN n ON n.case_id = b.item_id)
SELECT item_id AS case_id, n AS n_expected, round(CASE WHEN n > 0 THEN m5 / n ELSE 0 END, 6) AS recall5, round(CASE WHEN n > 0 THEN m10 / n ELSE 0 END, 6) AS recall10,
  round(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END, 6) AS mrr5, CAST(coalesce(first <= 5, false) AS INTEGER) AS hit5 FROM a""")
def flagship_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark items over all lines, judged by which documents hold the item."""
    hits = fused_hits(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", "document_id"), "chunk_id")
    found = hits.select(F.col("query_id").alias("case_id"), "document_id", F.col("rrf_rank").alias("rank"))
    cases = questions(spark, sf_dir).select(F.col("query_id").alias("case_id"))
    out = metrics.case_metrics(cases, found, gold(spark, sf_dir))
    return out.select("case_id", "n_expected", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "mrr5")], "hit5")
