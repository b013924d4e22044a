"""Fair choices, layouts, counters, traces and semi-structured values over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import variants
from corvane.operators import counters, fairness, traces
from corvane.plans import query
from corvane.plans.model import SQL_CHUNKS, chunks, table
from corvane.sources import layout


@query(f"""
WITH c AS ({SQL_CHUNKS}), t AS (SELECT chunk_id, document_id, kb, lang, length(text) AS n, row_number() OVER (PARTITION BY kb || '-' || lang, document_id ORDER BY length(text) DESC, chunk_id) AS turn FROM c QUALIFY turn <= 2),
b AS (SELECT kb || '-' || lang AS base, count(*) AS supply FROM t GROUP BY 1),
l AS (SELECT max(level) AS level FROM (SELECT r.level, (SELECT sum(least(supply, r.level)) FROM b) AS used FROM range(0, 501) r(level)) WHERE used <= 500),
a AS (SELECT base, least(supply, level) + CASE WHEN supply > level AND row_number() OVER (PARTITION BY supply > level ORDER BY base) <= 500 - sum(least(supply, level)) OVER () THEN 1 ELSE 0 END AS allotted FROM b, l),
p AS (SELECT *, kb || '-' || lang AS base, row_number() OVER (PARTITION BY kb || '-' || lang ORDER BY turn, n DESC, chunk_id) AS "position" FROM t)
SELECT p.base, document_id, chunk_id, "position" FROM p JOIN a USING (base) WHERE "position" <= allotted""")
def fair_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred lines shared fairly over bases of unequal size, two of a document at most, longest first."""
    own = chunks(spark, sf_dir).select(F.concat("kb", F.lit("-"), "lang").alias("base"), "document_id", "chunk_id", F.length("text").alias("n"))
    return fairness.select_fairly(own, 500, [F.desc("n"), "chunk_id"]).drop("n")


#: Pages of 31 lines: two headings across, each above two columns.
PAGE = 31


@query(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id AS document_id, line_no // {PAGE} AS page, line_no AS box_id, line_no % {PAGE} AS "position" FROM c""")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines laid out on pages, and read back in order from their boxes alone."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    at = F.col("line_no") % PAGE
    second = at >= 16
    k = F.when(second, at - 16).otherwise(at)  # place in its half: 0 is the heading
    rows, rest = F.when(second, 7).otherwise(8), k - 1
    column, row = F.floor(rest / rows), rest % rows
    top = F.when(second, 300.0).otherwise(40.0)
    x0 = F.when(k == 0, 50.0).otherwise(50.0 + 270.0 * column)
    width = F.when(k == 0, 500.0).otherwise(60.0 + (F.length("text") * 7) % 170)
    y0 = top + F.when(k == 0, 0.0).otherwise(30.0 + 25.0 * row)
    boxes = lines.select(F.col("doc_id").alias("document_id"), F.floor(F.col("line_no") / PAGE).alias("page"), F.col("line_no").cast("long").alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + 12.0).alias("y1"))
    return layout.reading_order(boxes)


SQL_COUNTER = """e AS (SELECT user_id % 7 AS series, epoch_us(ts) // 1000000 AS "when", event_id, event_type FROM events),
k AS (SELECT *, sum(CASE WHEN event_type = 'signup' AND event_id % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "when", event_id) AS life FROM e),
v AS (SELECT series, "when", CAST(max(value) AS DOUBLE) AS value FROM (SELECT series, "when", row_number() OVER (PARTITION BY series, life ORDER BY "when", event_id) AS value FROM k) GROUP BY ALL)"""


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of seven series' events that start anew now and then."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("series"), F.expr("unix_seconds(CAST(ts AS TIMESTAMP))").alias("at"), "event_id", "event_type")
    anew = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 9 == 0), 1).otherwise(0)
    life = F.sum(anew).over(Window.partitionBy("series").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("life", life).withColumn("value", F.row_number().over(Window.partitionBy("series", "life").orderBy("at", "event_id")).cast("double"))


@query(f"""WITH {SQL_COUNTER}, o AS (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY series ORDER BY "when") THEN lag(value) OVER (PARTITION BY series ORDER BY "when") ELSE 0 END AS lost FROM v),
t AS (SELECT *, value + sum(lost) OVER (PARTITION BY series ORDER BY "when" ROWS UNBOUNDED PRECEDING) AS total FROM o),
x AS (SELECT *, unnest(range(CAST(ceil("when" / 3600) AS BIGINT) * 3600, "when" + 21600, 3600)) AS "end" FROM t),
p AS (SELECT series, "end", count(*) AS n, min("when") AS f, max("when") AS l, arg_min(value, "when") AS s, arg_max(total, "when") - arg_min(total, "when") AS d FROM x GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT *, (l - f)::DOUBLE AS span, (l - f)::DOUBLE / (n - 1) AS mean, f - ("end" - 21600) AS a, "end" - l AS z FROM p),
r AS (SELECT series, "end", d * (span + least(CASE WHEN a < mean * 1.1::DOUBLE THEN a ELSE mean * 0.5::DOUBLE END, CASE WHEN d > 0 AND s >= 0 THEN span * s / d END) + CASE WHEN z < mean * 1.1::DOUBLE THEN z ELSE mean * 0.5::DOUBLE END) / span AS increase FROM g)
SELECT series, "end", round(increase, 4) AS increase, round(increase / 6, 4) AS hourly FROM r""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increases over six hours, every hour, of counters that start anew."""
    r = counters.rates(_counter(spark, sf_dir), 6 * 3600, 3600)
    return r.select("series", "end", F.round("increase", 4).alias("increase"), F.round(F.col("rate") * 3600, 4).alias("hourly"))


@query("""WITH b AS (SELECT event_type AS key, unnest([1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 'inf'::DOUBLE]) AS bound, value FROM events WHERE value IS NOT NULL),
c AS (SELECT key, bound, count(*) FILTER (value <= bound) AS n FROM b GROUP BY ALL),
w AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY key ORDER BY bound) AS below, lag(bound) OVER (PARTITION BY key ORDER BY bound) AS low, max(n) OVER (PARTITION BY key) * 0.95::DOUBLE AS rank FROM c),
f AS (SELECT * FROM w WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY key ORDER BY bound) = 1)
SELECT key AS event_type, round(CASE WHEN bound = 'inf'::DOUBLE THEN low ELSE coalesce(low, 0) + (bound - coalesce(low, 0)) * (rank - below) / (n - below) END, 6) AS p95 FROM f""")
def bucket_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of each type's values, from counts up to seven bounds."""
    bounds = F.array(*[F.lit(x) for x in (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, float("inf"))])
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("key"), F.explode(bounds).alias("bound"), "value")
    b = e.groupBy("key", "bound").agg(F.count_if(F.col("value") <= F.col("bound")).alias("count"))
    return counters.bucket_quantile(b, 0.95).select(F.col("key").alias("event_type"), F.round("quantile", 6).alias("p95"))


@query()
def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of users' stages, by events that start, end or fail them (an order-dependent stack: tests hold it against a loop)."""
    kind = F.when(F.col("event_type").isin("view", "click"), traces.START).when(F.col("event_type") == "error", traces.FAIL).otherwise(traces.END)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("at"), F.concat(F.lit("stage"), F.col("event_id") % 3).alias("stage"), kind.alias("kind"))
    return traces.spans(e)


@query("""WITH v AS (SELECT event_id, CAST(props AS JSON) AS p, json_object('k', event_id % 10, 'type', event_type) AS o FROM events)
SELECT event_id, CASE json_type(p) WHEN 'OBJECT' THEN 'object' END AS kind, CASE json_type(p, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' END AS k_kind, CAST(json_extract(p, '$.k') AS BIGINT) AS k, json_exists(p, '$.k') AS has_k, json_exists(p, '$.z') AS has_z,
  json_merge_patch(p, o) ->> '$.k' AS merged_k, json_merge_patch(p, o) ->> '$.type' AS merged_type, json_contains(p, json_object('k', event_id % 10)) AS holds FROM v""")
def variant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, keys, paths, merging and containment of events' properties."""
    e = table(spark, sf_dir, "events")
    v, o = variants.parse(F.col("props")), F.to_json(F.struct((F.col("event_id") % 10).alias("k"), F.col("event_type").alias("type")))
    both = e.select("event_id", v.alias("p"), variants.parse(o).alias("o"), variants.parse(F.to_json(F.struct((F.col("event_id") % 10).alias("k")))).alias("one"))
    merged = F.try_parse_json(variants.merged(F.col("p"), F.col("o")))
    return both.select(
        "event_id", variants.type_of(F.col("p")).alias("kind"), variants.type_of(variants.at(F.col("p"), "$.k")).alias("k_kind"), variants.at(F.col("p"), "$.k", "bigint").alias("k"), variants.has_key(F.col("p"), F.lit("k")).alias("has_k"), variants.has_key(F.col("p"), F.lit("z")).alias("has_z"),
        variants.at(merged, "$.k", "string").alias("merged_k"), variants.at(merged, "$.type", "string").alias("merged_type"), variants.contains(F.col("p"), F.col("one")).alias("holds"),
    )
