"""The sample tables seen as the entities of a document collection.

Every view is an expression over one table, written so that DuckDB reads the
same text (``SQL_*``), and the queries' oracles build on those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document's current version: its organization, knowledge base, state, validity and access.
VERSION_COLUMNS = {
    "document_id": "doc_id",
    "org": "concat('org', CAST(doc_id % 3 AS STRING))",
    "kb": "source",
    "status": "CASE WHEN doc_id % 11 = 3 THEN 'ARCHIVED' ELSE 'ACTIVE' END",
    "version_status": "CASE WHEN doc_id % 13 = 5 THEN 'DRAFT' ELSE 'PUBLISHED' END",
    "from_day": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 400 END",
    "to_day": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 400 + 200 END",
    "access_mode": "CASE WHEN doc_id % 4 = 0 THEN 'ORGANIZATION' ELSE 'RESTRICTED' END",
    "lang": "lang",
    "n_chars": "n_chars",
    "text": "text",
}


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in VERSION_COLUMNS.items()])
    day = lambda c: F.timestamp_add("DAY", F.col(c), F.lit("2024-01-01").cast("timestamp"))
    return d.withColumns({
        "valid_from": F.when(F.col("from_day").isNotNull(), day("from_day")),
        "valid_to": F.when(F.col("to_day").isNotNull(), day("to_day")),
        "allowed_roles": F.when(F.col("document_id") % 2 == 0, F.array(F.lit("EDITOR"))).otherwise(F.array(F.lit("VIEWER"), F.lit("EDITOR"))),
        "allowed_users": F.array(F.col("document_id") % 50, F.col("document_id") % 7),
        "tags": F.array(F.col("lang"), F.concat(F.lit("t"), (F.col("document_id") % 4).cast("string"))),
        "metadata": F.to_json(F.struct(F.col("lang"), F.col("n_chars").alias("size"), F.when(F.col("document_id") % 6 != 0, F.concat(F.lit("owner"), (F.col("document_id") % 9).cast("string"))).alias("owner"), (F.col("document_id") % 2 == 0).alias("pinned"))),
    })


SQL_VERSIONS = (
    "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in VERSION_COLUMNS.items()) + """,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) END AS valid_from,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 + 200 AS INTEGER)) END AS valid_to,
  CASE WHEN doc_id % 2 = 0 THEN ['EDITOR'] ELSE ['VIEWER', 'EDITOR'] END AS allowed_roles,
  [doc_id % 50, doc_id % 7] AS allowed_users, [lang, 't' || (doc_id % 4)] AS tags,
  CASE WHEN doc_id % 6 <> 0 THEN 'owner' || (doc_id % 9) END AS owner, doc_id % 2 = 0 AS pinned
FROM documents"""
)
#: The versions that organization org1 sees on 2024-09-01.
SQL_VISIBLE = f"""SELECT * FROM ({SQL_VERSIONS}) WHERE org = 'org1' AND status = 'ACTIVE' AND version_status = 'PUBLISHED'
  AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-09-01') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-09-01')"""
AT = "2024-09-01"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "concat('org', CAST(c_nationkey % 3 AS STRING)) AS org", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'ADMIN' WHEN c_mktsegment = 'MACHINERY' THEN 'EDITOR' ELSE 'VIEWER' END AS role", "c_acctbal > 0 AS enabled"
    )


SQL_USERS = """SELECT c_custkey AS user_id, 'org' || (c_nationkey % 3) AS org,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'ADMIN' WHEN c_mktsegment = 'MACHINERY' THEN 'EDITOR' ELSE 'VIEWER' END AS role, c_acctbal > 0 AS enabled FROM customer"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as child chunks; eight lines are a parent, named by its first."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.trim("text") != "")
    return lines.select(
        (F.col("doc_id") * 100000 + F.col("line_no")).alias("chunk_id"), (F.col("doc_id") * 100000 + F.floor(F.col("line_no") / 8) * 8).alias("parent_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("kb"), "lang", "line_no", "text"
    )


SQL_CHUNKS = """SELECT doc_id * 100000 + i - 1 AS chunk_id, doc_id * 100000 + (i - 1) // 8 * 8 AS parent_id, doc_id AS document_id, source AS kb, lang, i - 1 AS line_no, text
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(text, ' ') <> ''"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases: a benchmark item asks for the documents that hold it."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("answer"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, document_id): which documents contain an item's whole passage.

    Items and documents meet on the item's longest inner word, which a document
    that holds the passage must hold as a word; then the whole passage is
    looked for. Items of one or two words, if any, are looked for everywhere.
    """
    words = F.split("text", r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), "text", longest.alias("word"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("doc_text"))
    held = docs.select("document_id", F.explode(F.array_distinct(F.split("doc_text", r"\s+"))).alias("word"))
    maybe = held.join(items.where(F.col("word").isNotNull()), "word").select("case_id", "text", "document_id")
    found = maybe.join(docs, "document_id").where(F.expr("contains(doc_text, text)")).select("case_id", "document_id")
    short = items.where(F.col("word").isNull()).join(docs, F.expr("contains(doc_text, text)")).select("case_id", "document_id")
    return found.unionByName(short)


SQL_GOLD = "SELECT item_id AS case_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
