"""Streams over the events table, read to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans import query
from corvane.plans.model import table
from corvane.sources.folders import workspace
from corvane.streaming import groups, jobs


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1")
def stream_deliver_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.deliver_once(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")


@query("SELECT CASE WHEN event_type <> 'error' AND value > 1 THEN 'good' ELSE 'dead' END AS queue, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, dead = jobs.split_dead_letters(spark, f"{sf_dir}/events.parquet", (F.col("event_type") != "error") & (F.col("value") > 1))
    both = good.withColumn("queue", F.lit("good")).unionByName(dead.withColumn("queue", F.lit("dead")))
    return both.groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DECIMAL(30,6)) AS total FROM events GROUP BY 1)
SELECT start, n, errors, CAST(round(total, 4) AS DOUBLE) AS total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = jobs.window_rates(spark, f"{sf_dir}/events.parquet")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors", F.round(F.col("total"), 4).cast("double").alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, k)
SELECT * FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.sessions(spark, f"{sf_dir}/events.parquet")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH g AS (SELECT user_id, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts) AS gap, ts FROM events),
a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS attempt FROM g WHERE gap > 72 * 3600)
SELECT user_id, attempt, CASE WHEN attempt >= 3 THEN 'FAIL' ELSE 'REQUEUE' END AS action FROM a""")
def stream_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stale_runs(spark, f"{sf_dir}/events.parquet")


@query("""WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)
SELECT event_id, sequence FROM s WHERE user_id = 7 AND sequence > 5 AND sequence <= coalesce((SELECT min(sequence) FROM s WHERE user_id = 7 AND event_type = 'error' AND sequence > 30), 1000000)""")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that saw five events of a run still gets, up to the run's terminal event."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    log = table(spark, sf_dir, "events").withColumn("sequence", seq).select("event_id", F.col("user_id").cast("string").alias("run_id"), "sequence", ((F.col("event_type") == "error") & (F.col("sequence") > 30)).alias("terminal"))
    return jobs.replay(log, "7", 5).select("event_id", "sequence")


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS duration_ms,
  CASE WHEN bool_or(event_type = 'error') THEN 'FAILED' WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'COMPLETED' ELSE 'RUNNING' END AS state, count(*) AS events FROM events GROUP BY user_id""")
def run_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count(F.lit(1)).alias("events"))
    state = F.when(F.col("failed"), "FAILED").when(F.col("last_type") == "purchase", "COMPLETED").otherwise("RUNNING")
    return e.select("user_id", "first_type", "last_type", F.expr("timestampdiff(MICROSECOND, a, b) div 1000").alias("duration_ms"), state.alias("state"), "events")


@query("""SELECT o_orderkey AS schedule_id, o_orderdate + to_days(CAST(7 * (1 + date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') // 7) AS INTEGER)) AS next_at FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderstatus = 'O'""")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly schedules that are due at a time, with when they are due next."""
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= now) & (F.col("o_orderstatus") == "O"))
    days = F.datediff(now.cast("date"), F.col("o_orderdate").cast("date"))
    weeks = (F.floor(days / 7) + 1).cast("int")
    return o.select(F.col("o_orderkey").alias("schedule_id"), (F.col("o_orderdate") + F.make_dt_interval(weeks * 7)).alias("next_at"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus IN ('F', 'O') AS terminal FROM orders) SELECT a.id AS pair FROM r a JOIN r b ON b.id = a.id + 1 WHERE a.terminal AND b.terminal""")
def paired_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons both of whose runs have ended."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderkey").alias("pair"))
    return done.join(done.select((F.col("pair") - 1).alias("pair")), "pair", "left_semi")


IDLE = 12 * 3_600_000
GROUP_MESSAGES = """SELECT user_id % 16 AS queue, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'POLL' WHEN 'signup' THEN 'ACK' WHEN 'error' THEN 'RESTART' ELSE 'ADD' END AS kind, event_id % 3 AS consumer, event_id AS job"""
_GIVEN = "lambda p: {{'s': p.s, 'j': p.j, 'c': m.consumer, 'tm': m.tm, 'd': p.d + 1, 'f': true}}".replace("{{", "{").replace("}}", "}")
_TOLD = "lambda p: {'s': p.s, 'j': p.j, 'c': p.c, 'd': p.d, 'action': "


@query(f"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (PARTITION BY queue ORDER BY tm, seq) AS step FROM ({GROUP_MESSAGES}, epoch_us(ts) // 1000 AS tm FROM events)
), walk(queue, step, tm, seq, waiting, pending, told) AS (
  SELECT DISTINCT queue, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, j BIGINT)[]), CAST([] AS STRUCT(s BIGINT, j BIGINT, c BIGINT, tm BIGINT, d INTEGER, f BOOLEAN)[]),
    CAST([] AS STRUCT(s BIGINT, j BIGINT, c BIGINT, d INTEGER, action VARCHAR)[]) FROM m
  UNION ALL
  SELECT queue, step, tm, seq, CASE WHEN kind = 'ADD' THEN list_append(waiting, {{'s': step, 'j': job}}) WHEN src = 'NEW' THEN waiting[5:] ELSE waiting END,
    CASE WHEN kind = 'RESTART' THEN list_transform(pending, lambda p: {{'s': p.s, 'j': p.j, 'c': p.c, 'tm': p.tm, 'd': p.d, 'f': p.f AND p.c <> consumer}})
      WHEN kind IN ('ACK', 'POLL') THEN list_sort(list_concat(list_filter(pending, lambda p: NOT list_contains(list_transform(list_concat(acked, given, dead), lambda x: x.s), p.s)), given)) ELSE pending END,
    list_concat(list_transform(acked, {_TOLD}'ACK'}}), list_transform(given, {_TOLD}src}}), list_transform(dead, {_TOLD}'DEAD'}}))
  FROM (SELECT m.*, waiting, pending, src, CASE WHEN m.kind = 'ACK' THEN list_filter(pending, lambda p: p.c = m.consumer AND p.f)[1:4] ELSE [] END AS acked,
      CASE src WHEN 'OWN' THEN list_transform(own[1:4], {_GIVEN}) WHEN 'RECLAIMED' THEN list_transform(list_filter(idle[1:8], lambda p: p.d < 3), {_GIVEN})
        WHEN 'NEW' THEN list_transform(waiting[1:4], lambda w: {{'s': w.s, 'j': w.j, 'c': m.consumer, 'tm': m.tm, 'd': CAST(1 AS INTEGER), 'f': true}}) ELSE [] END AS given,
      CASE WHEN src = 'RECLAIMED' THEN list_filter(idle[1:8], lambda p: p.d >= 3) ELSE [] END AS dead
    FROM (SELECT w.queue, w.waiting, w.pending, m.step AS next, list_filter(w.pending, lambda p: p.c = m.consumer AND NOT p.f) AS own, list_filter(w.pending, lambda p: p.c <> m.consumer AND m.tm - p.tm >= {IDLE}) AS idle,
        CASE WHEN m.kind <> 'POLL' THEN '' WHEN len(list_filter(w.pending, lambda p: p.c = m.consumer AND NOT p.f)) > 0 THEN 'OWN' WHEN len(list_filter(w.pending, lambda p: p.c <> m.consumer AND m.tm - p.tm >= {IDLE})) > 0 THEN 'RECLAIMED' ELSE 'NEW' END AS src
      FROM walk w JOIN m ON m.queue = w.queue AND m.step = w.step + 1) x JOIN m ON m.queue = x.queue AND m.step = x.next)
), rows_ AS (
  SELECT queue, step, tm, seq, t.s AS entry, t.action AS action, t.c AS consumer, t.j AS job, t.d AS deliveries FROM (SELECT queue, step, tm, seq, unnest(told) AS t FROM walk)
), next_ AS (
  SELECT *, lead(tm) OVER (PARTITION BY queue, entry ORDER BY step) AS touched FROM rows_
)
SELECT queue, tm AS "at", seq, action, consumer, job, deliveries FROM rows_
UNION ALL
SELECT queue, tm + {IDLE}, 0, 'STALE', consumer, job, deliveries FROM next_ WHERE action IN ('OWN', 'RECLAIMED', 'NEW') AND coalesce(touched, (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)) >= tm + {IDLE}""")
def stream_consumer_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of 16 queues and three consumers each: own pending work, idle work of others, new work, and what fell silent."""
    source = jobs.events(spark, f"{sf_dir}/events.parquet")
    messages = source.selectExpr("ts", *[x.strip() for x in GROUP_MESSAGES.removeprefix("SELECT ").split(", ")])
    return jobs.finish(groups.deliveries(messages, idle_ms=IDLE), workspace(spark, "stream"))
