"""Joins, aggregates, windows, JSON and set operations that the services run on their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, chunks, table


@query("""SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name""")
def effective_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of equi-joins to small dimensions, summed before the dimensions are joined."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return o.join(c, "o_custkey").groupBy("n_nationkey").agg(F.sum("orders").alias("orders"), F.sum("total").alias("total")).join(F.broadcast(dims), "n_nationkey").select("n_name", "r_name", "orders", F.round("total", 2).alias("total"))  # 25 nations


@query("""SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey, (SELECT 1000.0 AS floor) p WHERE o_totalprice > p.floor AND c_acctbal < p.floor""")
def parameter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row relation of parameters, folded into the plan as literals."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.where(F.col("o_totalprice") > 1000.0).join(c.where(F.col("c_acctbal") < 1000.0), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_totalprice", "c_acctbal")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(back, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("""WITH a AS (SELECT l_orderkey AS answer, list(l_partkey) AS cited FROM lineitem GROUP BY l_orderkey)
SELECT answer FROM a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(a.cited) AS p) u WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = u.p AND p_size > 2))""")
def all_cited_accessible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers all of whose cited items are accessible: the bad ones are found by unnesting and taken away."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer")).agg(F.collect_list("l_partkey").alias("cited"))
    ok = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("item"))
    bad = a.select("answer", F.explode("cited").alias("item")).join(ok, "item", "left_anti").select("answer")
    return a.join(bad, "answer", "left_anti").select("answer")


@query("""SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def latest_per_key_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its latest order, if any: one aggregate instead of a lookup for each row."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("""SELECT s_suppkey, coalesce(x.n, 0) AS n, x.avg_quantity FROM supplier LEFT JOIN LATERAL (SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem WHERE l_suppkey = s_suppkey) x ON true""")
def lateral_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
    return table(spark, sf_dir, "supplier").join(x, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), "avg_quantity")


@query("SELECT event_id, key, CAST(value AS BIGINT) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, key) AS value)")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a JSON object as rows."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


@query(f"""WITH c AS (SELECT chunk_id, sha256(text) AS h FROM ({SQL_CHUNKS})), have AS (SELECT h, min(chunk_id) AS from_chunk_id FROM c WHERE chunk_id % 2 = 0 GROUP BY h)
SELECT c.chunk_id, from_chunk_id FROM c JOIN have USING (h) WHERE c.chunk_id % 2 <> 0""")
def hash_reuse_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import ingest

    c = chunks(spark, sf_dir).select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.lit("p").alias("policy"))
    return ingest.reuse_embeddings(c, c.where("chunk_id % 2 = 0").select("chunk_id"))


@query(f"WITH c AS ({SQL_CHUNKS}) SELECT p.chunk_id AS parent_id, count(*) AS n_children, CAST(sum(length(k.text)) AS BIGINT) AS n_chars FROM c p JOIN c k ON k.parent_id = p.chunk_id GROUP BY p.chunk_id")
def parent_child_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    kids = c.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.length("text")).alias("n_chars"))
    return kids.join(c.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_semi")


@query("SELECT p.o_orderkey AS pair, e.event_id FROM orders p JOIN events e ON e.event_id = p.o_orderkey OR e.event_id = p.o_orderkey + 7")
def disjunctive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is one of two ids: a union of two equi-joins instead of a nested loop."""
    o, e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair")), table(spark, sf_dir, "events").select("event_id")
    both = o.select("pair", F.explode(F.array("pair", F.col("pair") + 7)).alias("event_id"))
    return both.join(e, "event_id").select("pair", "event_id").distinct()


@query("SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON coalesce(nullif(e.user_id % 50, 0), 51) = o.o_custkey AND e.event_type = 'purchase'")
def coalesced_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.coalesce(F.nullif(F.col("user_id") % 50, F.lit(0)), F.lit(51)).alias("o_custkey"))
    return e.join(table(spark, sf_dir, "orders"), "o_custkey").select("event_id", "o_orderkey")


@query("""SELECT o_orderkey, count(*) AS in_force FROM orders JOIN (SELECT l_suppkey, l_partkey, l_shipdate AS f, l_shipdate + INTERVAL 30 DAY AS t FROM lineitem) v ON v.l_suppkey = o_custkey % 100 AND f <= o_orderdate AND t > o_orderdate GROUP BY o_orderkey""")
def temporal_validity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in force at an order's time: equal key and a half-open interval."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), "o_orderdate")
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("f"), F.expr("l_shipdate + INTERVAL 30 DAY").alias("t"))
    return o.join(v, "l_suppkey").where("f <= o_orderdate AND t > o_orderdate").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("in_force"))


@query("""SELECT a.o_orderkey AS fast_id, b.o_orderkey AS deep_id, round(b.o_totalprice - a.o_totalprice, 2) AS difference FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderstatus = a.o_orderstatus""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = o.select((F.col("o_orderkey") + 1).alias("deep_id"), F.col("o_orderkey").alias("fast_id"), "o_orderstatus", F.col("o_totalprice").alias("x")), o.select(F.col("o_orderkey").alias("deep_id"), "o_orderstatus", F.col("o_totalprice").alias("y"))
    return a.join(b, ["deep_id", "o_orderstatus"]).select("fast_id", "deep_id", F.round(F.col("y") - F.col("x"), 2).alias("difference"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'CLOSED' ELSE c_mktsegment END AS status FROM customer""")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column recomputed from a join, in place of an update."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("done", F.lit(True))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left").select("c_custkey", F.when(F.col("done"), "CLOSED").otherwise(F.col("c_mktsegment")).alias("status"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS large, min(l_quantity) FILTER (WHERE l_discount > 0.05) AS least, round(sum(l_extendedprice) FILTER (WHERE l_tax < 0.04), 2) AS low_tax,
  count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS open_suppliers, bool_or(l_discount > 0.09) AS deep_discount FROM lineitem GROUP BY l_returnflag""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c, x: F.when(F.expr(c), F.col(x))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.min(when("l_discount > 0.05D", "l_quantity")).alias("least"), F.round(F.sum(when("l_tax < 0.04D", "l_extendedprice")), 2).alias("low_tax"),
        F.count_distinct(when("l_linestatus = 'O'", "l_suppkey")).alias("open_suppliers"), F.bool_or(F.expr("l_discount > 0.09D")).alias("deep_discount"),
    )


@query("SELECT event_type, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def json_token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("bigint")), F.lit(0)).alias("tokens"), F.count_distinct("user_id").alias("users"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m-%d'))) AS days, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey")
def ordered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("days"), F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("first_part"))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linestatus)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_contains(s, 'O') AS has_open, list_has_any(s, ['F', 'X']) AS overlaps, list_has_all(['F', 'O'], s) AS within, len(s) AS n FROM a""")
def array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linestatus")).alias("s"))
    both = F.array(F.lit("F"), F.lit("O"))
    return a.select("l_orderkey", F.array_contains("s", "O").alias("has_open"), F.arrays_overlap("s", F.array(F.lit("F"), F.lit("X"))).alias("overlaps"), (F.size(F.array_except("s", both)) == 0).alias("within"), F.size("s").alias("n"))


@query("""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0) AS floor0, least(c_acctbal, 5000) AS cap, nullif(c_nationkey, 3) IS DISTINCT FROM 5 AS not_five FROM customer""")
def null_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"), F.greatest("c_acctbal", F.lit(0.0)).alias("floor0"), F.least("c_acctbal", F.lit(5000.0)).alias("cap"), (~F.nullif(F.col("c_nationkey"), F.lit(3)).eqNullSafe(F.lit(5))).alias("not_five"))


@query("""SELECT o_orderkey, CAST(epoch_ms(l) - epoch_ms(o_orderdate) AS BIGINT) AS ms, o_orderdate + to_minutes(CAST(o_orderkey % 90 AS INTEGER)) AS next_at FROM (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey""")
def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l"))
    o = table(spark, sf_dir, "orders").join(last, "o_orderkey")
    return o.select("o_orderkey", F.expr("timestampdiff(MILLISECOND, o_orderdate, l)").alias("ms"), F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 90 AS INT))").alias("next_at"))


@query("""SELECT s.source AS kb, s.documents, s.ready, s.failed, coalesce(l.labelled, 0) AS labelled, greatest(s.newest, coalesce(l.newest, -1)) AS activity
FROM (SELECT source, count(*) AS documents, count(*) FILTER (WHERE n_chars > 200) AS ready, count(*) FILTER (WHERE n_chars < 20) AS failed, max(doc_id) AS newest FROM documents GROUP BY source) s
LEFT JOIN (SELECT source, count(*) AS labelled, max(d.doc_id) AS newest FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source) l USING (source)""")
def kb_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n_chars") > 200).alias("ready"), F.count_if(F.col("n_chars") < 20).alias("failed"), F.max("doc_id").alias("newest"))
    l = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.max("doc_id").alias("last"))  # noqa: E741
    return s.join(l, "source", "left").select(F.col("source").alias("kb"), "documents", "ready", "failed", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.greatest("newest", F.coalesce("last", F.lit(-1))).alias("activity"))


@query("SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS question, count(*) AS n, min(conv_id) AS first_case FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1")
def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.sources.imports import repeated_questions as repeated

    return repeated(table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("question"), F.col("conv_id").alias("case_id")))


@query("""SELECT doc_id, n FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY sha256(text)) AS c FROM documents) WHERE n = 1 AND c > 1""")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text that occurs more than once: an aggregate, so a group of copies is one row from the start."""
    g = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c"))
    return g.where("c > 1").select("doc_id", F.lit(1).alias("n"))


@query("""SELECT chunk_id, source, priority FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY priority, source) AS n FROM (
  SELECT l_partkey AS chunk_id, 'cited' AS source, 1 AS priority FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'evidence', 2 FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT p_partkey, 'ranked', 3 FROM part UNION ALL SELECT l_partkey, 'raw', 4 FROM lineitem)) WHERE n = 1""")
def candidates_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lists of candidates in order of priority, each chunk once."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    tag = lambda d, c, s, p: d.select(F.col(c).alias("chunk_id"), F.lit(s).alias("source"), F.lit(p).alias("priority"))
    u = tag(l.where("l_returnflag = 'R'"), "l_partkey", "cited", 1).unionByName(tag(l.where("l_returnflag = 'A'"), "l_partkey", "evidence", 2)).unionByName(tag(table(spark, sf_dir, "part"), "p_partkey", "ranked", 3)).unionByName(tag(l, "l_partkey", "raw", 4))
    return u.groupBy("chunk_id").agg(F.min(F.struct("priority", "source")).alias("b")).select("chunk_id", "b.source", "b.priority")


@query("""SELECT goal, quote, phase FROM (SELECT l_linenumber AS goal, l_partkey % 50 AS quote, l_shipdate, l_returnflag AS phase, row_number() OVER (PARTITION BY l_linenumber, l_partkey % 50 ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_shipdate, l_orderkey) AS n FROM lineitem) WHERE n = 1""")
def quote_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("goal"), (F.col("l_partkey") % 50).alias("quote"))
    return g.agg(F.min_by("l_returnflag", F.struct(phase, "l_shipdate", "l_orderkey")).alias("phase"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"))


@query("""SELECT goal, place, doc FROM (SELECT *, row_number() OVER (ORDER BY place, goal) AS line FROM (SELECT l_linenumber AS goal, l_partkey AS doc, row_number() OVER (PARTITION BY l_linenumber ORDER BY sum(l_quantity) DESC, l_partkey) AS place FROM lineitem GROUP BY l_linenumber, l_partkey)) WHERE line <= 40""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.ranking import interleave

    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("goal"), F.col("l_partkey").alias("doc")).agg(F.sum("l_quantity").alias("q"))
    return interleave(g, ["goal"], [F.desc("q"), "doc"], 40).select("goal", F.col("depth").alias("place"), "doc")


@query("SELECT l_partkey AS key, 'extra' AS side FROM (SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT p_partkey, 'both' FROM (SELECT p_partkey FROM part WHERE p_size > 25 INTERSECT SELECT l_partkey FROM lineitem)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("key"))
    return used.subtract(known).select("key", F.lit("extra").alias("side")).unionByName(known.intersect(used).select("key", F.lit("both").alias("side")))


@query("SELECT label AS generation, count(vec_id) AS vectors FROM (SELECT range AS label FROM range(12)) LEFT JOIN embeddings USING (label) GROUP BY label")
def generation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = spark.range(12).select(F.col("id").cast("int").alias("label"))
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("vec_id").alias("vectors"))
    return gens.join(n, "label", "left").select(F.col("label").cast("long").alias("generation"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


@query("SELECT o_orderpriority, o_orderstatus, min(o_orderdate) AS first_seen FROM orders GROUP BY o_orderpriority, o_orderstatus")
def group_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_orderdate").alias("first_seen"))
