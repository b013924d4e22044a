"""Incremental ingestion over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import ingest
from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, SQL_VERSIONS, chunks, table, versions
from corvane.sources import imports, workbooks
from corvane.sources.folders import workspace


@query(f"WITH c AS ({SQL_CHUNKS}) SELECT chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = chunk_id % 700)")
def missing_embeddings_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return ingest.missing(chunks(spark, sf_dir).select("chunk_id", (F.col("chunk_id") % 700).alias("key")), have, ["key"]).select("chunk_id")


SQL_OLD = f"SELECT document_id, line_no AS position, sha256(text) AS hash FROM ({SQL_CHUNKS})"
SQL_NEW = f"SELECT document_id, CASE WHEN document_id % 4 = 0 THEN line_no + 1 ELSE line_no END AS position, sha256(CASE WHEN line_no % 6 = 2 THEN text || '!' ELSE text END) AS hash FROM ({SQL_CHUNKS}) WHERE NOT (document_id % 5 = 0 AND line_no % 7 = 3)"


@query(f"""WITH o AS ({SQL_OLD}), n AS ({SQL_NEW})
SELECT document_id, position, hash, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.document_id = n.document_id AND o.hash = n.hash) THEN 'UNCHANGED' WHEN EXISTS (SELECT 1 FROM o WHERE o.document_id = n.document_id AND o.position = n.position) THEN 'MODIFIED' ELSE 'ADDED' END AS change FROM n
UNION ALL SELECT document_id, position, hash, 'REMOVED' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.document_id = n.document_id AND o.hash = n.hash) AND NOT EXISTS (SELECT 1 FROM n WHERE o.document_id = n.document_id AND o.position = n.position)""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    hashed = lambda t: F.sha2(t.cast("binary"), 256).alias("hash")
    old = c.select("document_id", F.col("line_no").alias("position"), hashed(F.col("text")))
    changed = F.when(F.col("line_no") % 6 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = c.where("NOT (document_id % 5 = 0 AND line_no % 7 = 3)").select("document_id", F.when(F.col("document_id") % 4 == 0, F.col("line_no") + 1).otherwise(F.col("line_no")).alias("position"), hashed(changed))
    return ingest.version_diff(old, new)


@query("""WITH v AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'READY' ELSE 'DRAFT' END AS state FROM orders)
SELECT document_id, version_id, state, CASE WHEN state <> 'DRAFT' AND row_number() OVER (PARTITION BY document_id, state <> 'DRAFT' ORDER BY version_id DESC) = 1 THEN 'PUBLISHED' WHEN state = 'PUBLISHED' THEN 'SUPERSEDED' ELSE state END AS new_state FROM v""")
def publish_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.when(s == "F", "PUBLISHED").when(s == "O", "READY").otherwise("DRAFT").alias("state"))
    return ingest.publish(v, [F.desc("version_id")]).select("document_id", "version_id", "state", "new_state")


@query(f"SELECT document_id, CASE WHEN valid_to <= TIMESTAMP '2025-01-01' THEN 'EXPIRED' ELSE 'ACTIVE' END AS new_status FROM ({SQL_VERSIONS}) WHERE status = 'ACTIVE'")
def expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return ingest.expire(v.select("document_id", "status"), v.select("document_id", "valid_to", F.lit(True).alias("is_current")), F.lit("2025-01-01").cast("timestamp"))


@query("SELECT o_orderkey AS version_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "SUPERSEDED").alias("state"), F.col("o_orderdate").alias("updated_at"))
    refs = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("version_id"))
    return ingest.removable(v, refs, F.lit("1996-01-01").cast("timestamp_ntz")).select("version_id")


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT o_custkey, 'order ' || o_orderkey, round(o_totalprice, 2) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))
    changes = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.round("o_totalprice", 2).alias("balance"), "o_orderdate", "o_orderkey")
    return ingest.upsert(base, changes, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "c_name", "balance")


@query(f"""SELECT document_id, line_no, CAST(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY line_no) - length(text) - 2 AS BIGINT) AS source_start, CAST(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY line_no) - 2 AS BIGINT) AS source_end FROM ({SQL_CHUNKS})""")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ingest.map_offsets(chunks(spark, sf_dir).select("document_id", F.col("line_no").alias("order_index"), "text"))
    return b.select("document_id", F.col("order_index").alias("line_no"), "source_start", "source_end")


@query(f"""WITH c AS ({SQL_CHUNKS}), m AS (SELECT c.chunk_id, c.text AS piece, d.text AS whole FROM c JOIN documents d ON d.doc_id = c.document_id)
SELECT chunk_id, CASE WHEN instr(substr(whole, instr(whole, piece) + 1), piece) = 0 THEN instr(whole, piece) - 1 END AS start FROM m""")
def source_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return ingest.locate_once(docs, chunks(spark, sf_dir).select("chunk_id", "document_id", "text"), "document_id").select("chunk_id", "start")


@query("SELECT label AS generation, count(DISTINCT vec_id) AS n_vectors, count(DISTINCT vec_id) = (SELECT count(*) FROM embeddings) AS complete FROM embeddings GROUP BY label")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("generation"))
    return ingest.covered(e.select("chunk_id"), e)


@query("""WITH m AS (SELECT row_number() OVER (ORDER BY c_custkey) AS row_no, CASE WHEN c_custkey % 40 = 0 THEN upper('file' || c_custkey % 60) WHEN c_custkey % 41 = 0 THEN '' ELSE 'file' || c_custkey END AS file_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey WHEN c_custkey % 11 = 0 THEN NULL ELSE '' || c_custkey END AS size FROM customer),
f AS (SELECT *, min(row_no) OVER (PARTITION BY lower(trim(file_name))) AS first FROM m)
SELECT row_no, file_name, TRY_CAST(size AS DECIMAL(38,10)) AS size, list_filter([CASE WHEN trim(file_name) = '' THEN 'file_name: missing' END, CASE WHEN trim(file_name) <> '' AND first < row_no THEN 'file_name: first in row ' || first END,
  CASE WHEN size IS NULL THEN 'size: missing' END, CASE WHEN size IS NOT NULL AND TRY_CAST(size AS DECIMAL(38,10)) IS NULL THEN 'size: not number' END], lambda x: x IS NOT NULL) AS errors FROM f""")
def manifest_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    m = c.select(
        F.row_number().over(Window.orderBy("c_custkey")).alias("row_no"), F.when(k % 40 == 0, F.upper(F.concat(F.lit("file"), s(k % 60)))).when(k % 41 == 0, "").otherwise(F.concat(F.lit("file"), s(k))).alias("file_name"), F.when(k % 7 == 0, F.concat(F.lit("x"), s(k))).when(k % 11 == 0, None).otherwise(s(k)).alias("size")
    )
    return imports.manifest(m, {"size": ("NUMBER", True)})


@query("""WITH r AS (SELECT o_orderkey AS row_no, 'k' || o_orderkey % 300 AS key FROM orders), d AS (SELECT 'k' || (CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 1 ELSE c_custkey END) AS key, c_custkey AS id FROM customer),
g AS (SELECT key, count(*) AS n, min(id) AS id FROM d GROUP BY key)
SELECT row_no, key, CASE WHEN n = 1 THEN id END AS document_id, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'ambiguous' END AS error FROM r LEFT JOIN g USING (key)""")
def query_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: F.concat(F.lit("k"), x.cast("string")).alias("key")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), s(F.col("o_orderkey") % 300))
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(s(F.when(k % 9 == 0, k + 1).otherwise(k)), k.alias("document_id"))
    return imports.resolve_keys(r, d)


@query("""WITH e AS (SELECT DISTINCT sha256(text) AS h, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS doc_id FROM documents WHERE n_chars BETWEEN 100 AND 5000)
SELECT min(doc_id) AS doc_id, h AS hash FROM e GROUP BY h""")
def corpus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a fit length, one for each text."""
    d = table(spark, sf_dir, "documents").where("n_chars BETWEEN 100 AND 5000")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, sha256(text) AS sha256, doc_id % 3 <> 1 AS verified FROM documents WHERE text IS NOT NULL")
def content_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content against its declared hash: right, wrong, or all zero for unknown."""
    from corvane.sources.parsers import verify_content

    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("content"))
    m = F.col("doc_id") % 3
    declared = F.when(m == 0, F.sha2("content", 256)).when(m == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise("0" * 64)
    return verify_content(d.withColumn("declared_hash", declared)).select("doc_id", "sha256", "verified")


SQL_CELLS = """SELECT l_suppkey AS supplier, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS row, l_returnflag || '|' || l_linestatus AS flag,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(l_shipdate AS TIMESTAMP) AS shipped, l_discount > 0.05 AS cheap FROM lineitem"""


def _supplier_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of workbooks with a sheet for each supplier: a line's flags, quantity, date and whether it is cheap, written and read back.

    A supplier's lines are dealt and sorted once; their numbers keep that order, in which they are written.
    """
    workbooks.register(spark)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    dealt = table(spark, sf_dir, "lineitem").select("l_suppkey", *keys, "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "l_discount").repartition("l_suppkey").sortWithinPartitions("l_suppkey", *keys)
    lines = dealt.withColumn("row", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)))
    cell = lambda col, kind, value: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.alias("value"))
    cells = F.array(
        cell(1, "text", F.concat("l_returnflag", F.lit("|"), "l_linestatus")), cell(2, "number", F.col("l_quantity").cast("long").cast("string")),
        cell(3, "date", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")), cell(4, "boolean", (F.col("l_discount") > 0.05).cast("string")),
    )
    path = workspace(spark, "workbooks")
    lines.select(F.concat(F.lit("s"), "l_suppkey").alias("sheet"), "row", cells.alias("cells")).write.format(workbooks.NAME).mode("append").save(path)
    return spark.read.format(workbooks.NAME).option("splitBytes", 1_000_000).option("maxRows", 100_000).option("rows", "true").load(path)


@query(SQL_CELLS)
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _supplier_workbooks(spark, sf_dir)
    at = lambda n: F.get(F.filter("cells", lambda c: c["col"] == n), F.lit(0))["value"]
    return per.select(F.substring("sheet", 2, 20).cast("long").alias("supplier"), F.col("row").cast("long").alias("row"), at(1).alias("flag"), at(2).cast("long").alias("quantity"), at(3).cast("timestamp_ntz").alias("shipped"), at(4).cast("boolean").alias("cheap"))


@query(f"""WITH c AS ({SQL_CELLS}), w AS (SELECT *, (row - 1) // 50 AS "window", '| ' || replace(flag, '|', chr(92) || '|') || ' | ' || quantity || ' | ' || strftime(shipped, '%Y-%m-%d %H:%M:%S') || ' | ' || cheap || ' |' AS line FROM c),
a AS (SELECT supplier, "window", min(row) AS first_row, max(row) AS last_row, list(line ORDER BY row) AS lines FROM w GROUP BY ALL)
SELECT supplier, "window", first_row, last_row, md5(array_to_string(list_concat(lines[1:1], ['| --- | --- | --- | --- |'], lines[2:]), chr(10))) AS text_md5 FROM a""")
def workbook_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets in windows of 50 rows, as tables."""
    w = workbooks.row_windows(_supplier_workbooks(spark, sf_dir))
    return w.select(F.substring("sheet", 2, 20).cast("long").alias("supplier"), F.col("window").cast("long").alias("window"), F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
