"""Ingestion and event streams: de-duplication, dead letters, windows, replay, stale runs.

Each job reads a file stream to its end (``availableNow``) and leaves a table;
offsets and state live in the job's checkpoint, so a restart goes on where the
last run ended. Leases and fencing have no counterpart: Spark's commit protocol
keeps a batch's output from being written twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.sources.folders import workspace

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from a file or folder; times become UTC timestamps, as watermarks need."""
    return spark.readStream.schema(EVENTS).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def finish(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input into a Parquet table."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/table")


def deliver_once(spark: SparkSession, path: str, late: str = "40 days") -> DataFrame:
    """Events once each by id, however often they are delivered within ``late``."""
    return finish(events(spark, path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), workspace(spark, "stream"))


def split_dead_letters(spark: SparkSession, path: str, ok) -> tuple[DataFrame, DataFrame]:
    """Events that can be worked on, and those that can't, each written once for each batch."""
    out = workspace(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        for name, keep in (("good", ok), ("dead", ~F.coalesce(ok, F.lit(False)))):
            batch.where(F.coalesce(keep, F.lit(False))).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")  # a repeated batch replaces itself

    source = events(spark, path)
    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.parquet(f"{out}/{name}").select(*source.columns)
    return read("good"), read("dead")


def window_rates(spark: SparkSession, path: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts, errors and value sums of closed windows: start, n, errors, total."""
    w = F.window("ts", width)
    agg = events(spark, path).withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return finish(agg.select(F.col("window.start").alias("start"), "n", "errors", "total"), workspace(spark, "stream"))


def sessions(spark: SparkSession, path: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Closed sessions of users: user_id, start, end, n."""
    agg = events(spark, path).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return finish(agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"), workspace(spark, "stream"))


def replay(log: DataFrame, run: str, after: int) -> DataFrame:
    """A run's events after a sequence number, up to its terminal event."""
    own = log.where((F.col("run_id") == run) & (F.col("sequence") > after))
    end = log.where((F.col("run_id") == run) & F.col("terminal")).agg(F.min("sequence").alias("end"))
    return own.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("sequence") <= F.col("end"))).drop("end")  # one row


def stale_runs(spark: SparkSession, path: str, idle_hours: int = 72, max_attempts: int = 3) -> DataFrame:
    """Runs that fell silent: user_id, attempt, action, each time the gap between two events passes ``idle_hours``.

    The state is a run's last heartbeat and its attempts; the first gaps
    requeue it, and from ``max_attempts`` on it fails.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts = state.get if state.exists else (None, 0)
        found = []
        for t in sorted(t for pdf in batches for t in pdf["ts"]):
            at = int(t.timestamp())
            if last is not None and at - last > idle_hours * 3600:
                attempts += 1
                found.append((key[0], attempts, "FAIL" if attempts >= max_attempts else "REQUEUE"))
            last = at if last is None else max(last, at)
        state.update((last, attempts))
        yield pd.DataFrame(found, columns=["user_id", "attempt", "action"])

    out = events(spark, path).groupBy("user_id").applyInPandasWithState(watch, "user_id long, attempt int, action string", "last long, attempts int", "append", GroupStateTimeout.NoTimeout)
    return finish(out, workspace(spark, "stream"))
