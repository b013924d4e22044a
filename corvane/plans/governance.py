"""Scope, access, facets and content revisions over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import ingest, scope
from corvane.operators.scope import MetadataFilter
from corvane.plans import query
from corvane.plans.model import AT, SQL_CHUNKS, SQL_USERS, SQL_VERSIONS, SQL_VISIBLE, chunks, table, users, versions


def visible(spark: SparkSession, sf_dir: str, filters: tuple[MetadataFilter, ...] = ()) -> DataFrame:
    return scope.visible_versions(versions(spark, sf_dir), "org1", F.lit(AT).cast("timestamp"), filters=filters)


@query(f"SELECT document_id, kb, valid_from, valid_to FROM ({SQL_VISIBLE})")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(spark, sf_dir).select("document_id", "kb", "valid_from", "valid_to")


@query(f"SELECT document_id FROM ({SQL_VISIBLE}) WHERE kb IN ('src1', 'src2', 'src3') AND document_id IN (1, 4, 7, 10, 22, 61, 82, 121)")
def id_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.visible_versions(versions(spark, sf_dir), "org1", F.lit(AT).cast("timestamp"), ["src1", "src2", "src3"], [1, 4, 7, 10, 22, 61, 82, 121]).select("document_id")


SQL_REASON = "CASE WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN d.access_mode = 'ORGANIZATION' THEN 'ORGANIZATION' WHEN list_contains(d.allowed_users, u.user_id) THEN 'USER' WHEN list_contains(d.allowed_roles, u.role) THEN 'ROLE' ELSE 'DENIED' END"


@query(f"SELECT u.user_id, d.document_id, {SQL_REASON} AS reason FROM ({SQL_USERS}) u JOIN ({SQL_VERSIONS}) d ON u.org = d.org WHERE u.enabled AND u.user_id % 100 = 0")
def acl_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each user of a stated set (ids divisible by 100) sees each document of their organization."""
    return scope.document_access(users(spark, sf_dir).where("user_id % 100 = 0"), versions(spark, sf_dir))


@query(f"SELECT u.user_id, count(*) FILTER (WHERE {SQL_REASON} <> 'DENIED') AS visible FROM ({SQL_USERS}) u JOIN ({SQL_VERSIONS}) d ON u.org = d.org WHERE u.enabled GROUP BY u.user_id")
def acl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each user sees, by counting documents of a kind before users meet them.

    Documents that agree in organization, mode and roles are one row with a
    count; the few that name users are told apart by an equi-join.
    """
    d, u = versions(spark, sf_dir), users(spark, sf_dir).where("enabled")
    kinds = d.groupBy("org", "access_mode", "allowed_roles").agg(F.count(F.lit(1)).alias("n"))
    by_kind = F.when((F.col("role") == "ADMIN") | (F.col("access_mode") == "ORGANIZATION") | F.expr("array_contains(allowed_roles, role)"), F.col("n")).otherwise(0)
    base = u.join(kinds, "org").groupBy("user_id", "org", "role").agg(F.sum(by_kind).alias("n"))
    named = d.where(F.col("access_mode") != "ORGANIZATION").select("org", "document_id", "allowed_roles", F.explode(F.array_distinct("allowed_users")).alias("user_id"))
    extra = named.join(u, ["org", "user_id"]).where((F.col("role") != "ADMIN") & ~F.expr("array_contains(allowed_roles, role)")).groupBy("user_id").agg(F.count(F.lit(1)).alias("more"))
    return base.join(extra, "user_id", "left").select("user_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("visible"))


@query(f"""SELECT document_id FROM ({SQL_VISIBLE}) WHERE n_chars >= 500 AND n_chars < 4000 AND owner <> 'owner3' AND lang IN ('en', 'de') AND owner ILIKE '%R_4%' = false AND pinned""")
def metadata_filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed conditions on JSON metadata; a missing owner fails NE, as null does."""
    wanted = (MetadataFilter("size", "GTE", "NUMBER", 500), MetadataFilter("size", "LT", "NUMBER", 4000), MetadataFilter("owner", "NE", "TEXT", "owner3"), MetadataFilter("lang", "IN", "TEXT", values=("en", "de")), MetadataFilter("pinned", "EQ", "BOOLEAN", True))
    like = scope.metadata_predicate(MetadataFilter("owner", "CONTAINS", "TEXT", "R_4"), F.col("metadata"))
    return visible(spark, sf_dir, wanted).where(~like).select("document_id")


@query(f"SELECT document_id FROM ({SQL_VERSIONS}) WHERE list_has_any(tags, ['fr', 't2'])")
def tags_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scope.metadata_predicate(MetadataFilter("tags", "IN", "TEXT_LIST", values=("fr", "t2")), F.col("metadata"), {"tags": F.col("tags")})
    return versions(spark, sf_dir).where(p).select("document_id")


@query(f"SELECT DISTINCT owner AS value FROM ({SQL_VISIBLE}) WHERE owner IS NOT NULL ORDER BY 1 LIMIT 101")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.facet_values(visible(spark, sf_dir), "owner")


@query(f"""SELECT d.document_id, u.user_id FROM ({SQL_VISIBLE}) d JOIN ({SQL_USERS}) u ON u.org = d.org AND u.enabled AND {SQL_REASON} <> 'DENIED' WHERE u.user_id = d.document_id % 20""")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations (a document cited by a user) that still hold: the version is in force and the user may see it."""
    d = visible(spark, sf_dir).withColumn("cited_by", F.col("document_id") % 20).alias("d")
    u = users(spark, sf_dir).where("enabled").alias("u")
    met = d.join(u, (F.col("u.org") == F.col("d.org")) & (F.col("u.user_id") == F.col("d.cited_by")))
    return met.where(scope.access_reason("u", "d") != "DENIED").select("d.document_id", "u.user_id")


@query(f"""SELECT e.event_id FROM events e LEFT JOIN ({SQL_USERS}) u ON u.user_id = e.user_id % 97 WHERE e.user_id % 3 = 0 OR (u.role = 'ADMIN' AND u.enabled)""")
def run_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a creator or an enabled administrator may open: two semi-joins, united by id."""
    e = table(spark, sf_dir, "events").withColumn("viewer", F.col("user_id") % 97)
    admins = users(spark, sf_dir).where("enabled AND role = 'ADMIN'").select(F.col("user_id").alias("viewer"))
    return e.where("user_id % 3 = 0").select("event_id").union(e.where("user_id % 3 <> 0").join(admins, "viewer", "left_semi").select("event_id"))


@query(f"""WITH c AS (SELECT kb, sha256(text) AS hash FROM ({SQL_CHUNKS}))
SELECT kb, CAST(sum(n) AS BIGINT) AS n_chunks, min(low) AS min_hash, max(high) AS max_hash, sha256(string_agg(digest, chr(31) ORDER BY part)) AS revision
FROM (SELECT kb, substr(hash, 1, 3) AS part, count(*) AS n, min(hash) AS low, max(hash) AS high, sha256(string_agg(hash, chr(31) ORDER BY hash)) AS digest FROM c GROUP BY ALL) GROUP BY kb""")
def content_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.content_revision(chunks(spark, sf_dir).select("kb", F.sha2(F.col("text").cast("binary"), 256).alias("hash")))


@query(f"""SELECT count(*) AS cited, count(*) FILTER (WHERE o_custkey % 3 <> document_id % 3) AS scope_leaks,
  count(*) FILTER (WHERE NOT ((valid_from IS NULL OR valid_from <= o_orderdate) AND (valid_to IS NULL OR valid_to > o_orderdate))) AS version_leaks
FROM orders JOIN ({SQL_VERSIONS}) ON document_id = o_orderkey % 150""")
def effective_version_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from another organization, or from a version not in force when its run ended."""
    o = table(spark, sf_dir, "orders").withColumn("document_id", F.col("o_orderkey") % 150).withColumn("at", F.col("o_orderdate").cast("timestamp"))
    met = o.join(versions(spark, sf_dir).select("document_id", "valid_from", "valid_to"), "document_id")
    return met.agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("o_custkey") % 3 != F.col("document_id") % 3).alias("scope_leaks"), F.count_if(~scope.effective(F.col("at"), F.col("valid_from"), F.col("valid_to"))).alias("version_leaks"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system' AND NOT (role = 'user' AND turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id))) WHERE n <= 3""")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of each conversation that memory may see: no system text, and no user message still in flight."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    whole = Window.partitionBy("conv_id")
    seen = c.withColumn("last", F.max("turn").over(whole)).where("role <> 'system' AND NOT (role = 'user' AND turn = last)")
    return seen.withColumn("n", F.row_number().over(whole.orderBy(F.desc("turn")))).where("n <= 3").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected FROM (SELECT conv_id, turn + CASE WHEN conv_id % 17 = 0 AND turn > 1 THEN 1 ELSE 0 END AS turn FROM conversations)) WHERE turn <> expected")
def turn_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that don't follow on the one before (each seventeenth conversation lacks its third)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + F.when((F.col("conv_id") % 17 == 0) & (F.col("turn") > 1), 1).otherwise(0)).alias("turn"))
    return c.withColumn("expected", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).where("turn <> expected")


@query("SELECT conv_id, pinned, last_turn FROM (SELECT conv_id, conv_id % 9 = 0 AS pinned, max(turn) AS last_turn FROM conversations GROUP BY conv_id) WHERE (CASE WHEN pinned THEN 0 ELSE 1 END, -last_turn, -conv_id) > (1, -5, -60) ORDER BY CASE WHEN pinned THEN 0 ELSE 1 END, last_turn DESC, conv_id DESC LIMIT 21")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of conversations after the key (not pinned, 5, 60): pinned first, newest first; one more row tells of a next page."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn("pinned", F.col("conv_id") % 9 == 0)
    key = F.struct(F.when(F.col("pinned"), 0).otherwise(1), -F.col("last_turn"), -F.col("conv_id"))
    after = F.struct(F.lit(1), F.lit(-5).cast("long"), F.lit(-60).cast("long"))
    return c.where(key > after).orderBy(F.when(F.col("pinned"), 0).otherwise(1), F.desc("last_turn"), F.desc("conv_id")).limit(21).select("conv_id", "pinned", "last_turn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, n, fact FROM (SELECT o_custkey AS c_custkey, o_orderkey AS fact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1997-01-01') WHERE n <= 20""")
def memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest twenty confirmed facts that are valid by a date."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.withColumn("n", F.row_number().over(w)).where("n <= 20").select(F.col("o_custkey").alias("c_custkey"), "n", F.col("o_orderkey").alias("fact"))


@query("""WITH m AS (SELECT conv_id AS conversation_id, turn AS message_id, role, CASE WHEN (conv_id + turn) % 7 <> 0 THEN conv_id * 1000 + turn // 2 END AS turn_id, (conv_id * 1000 + turn // 2) * 2 AS run_id FROM conversations),
t AS (SELECT DISTINCT conv_id * 1000 + turn // 2 AS turn_id FROM conversations), a AS (SELECT turn_id, CASE WHEN turn_id % 11 <> 0 THEN turn_id * 2 + CASE WHEN turn_id % 4 = 0 THEN 1 ELSE 0 END END AS active FROM t),
v AS (SELECT m.*, row_number() OVER (PARTITION BY conversation_id ORDER BY message_id DESC) AS n FROM m LEFT JOIN a USING (turn_id)
  WHERE turn_id IS NULL OR role NOT IN ('user', 'assistant') OR (role = 'assistant' AND run_id = active) OR (role = 'user' AND active % 5 > 1))
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC) AS "position", message_id, role FROM v WHERE n <= 4""")
def visible_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest four messages that each conversation's memory sees, by their turns' active runs."""
    turn_id = (F.col("conv_id") * 1000 + F.expr("turn div 2")).cast("long")
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    m = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), F.col("turn").alias("created_at"), "role", F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, turn_id).alias("turn_id"), (turn_id * 2).alias("run_id"))
    t = c.select(turn_id.alias("turn_id")).distinct().withColumn("active_run_id", F.expr("CASE WHEN turn_id % 11 <> 0 THEN turn_id * 2 + IF(turn_id % 4 = 0, 1, 0) END"))
    r = t.where("active_run_id IS NOT NULL").select(F.col("active_run_id").alias("run_id"), F.expr("CASE active_run_id % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' ELSE 'COMPLETED' END").alias("status"))
    return scope.visible_messages(m, t, r, 4)
