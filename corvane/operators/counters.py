"""Rates of counters that start anew, and quantiles of cumulative buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far, in mean distances between samples, a window's edge may lie from the nearest sample to be reached (fixed values).
REACH, HALF = 1.1, 0.5


def corrected(samples: DataFrame) -> DataFrame:
    """``samples`` (series, at, value) with total: the value on top of what was lost whenever the counter began anew.

    Samples without a series, time or finite value are none; of a series' samples at one time the greatest counts.
    """
    good = samples.where(F.col("series").isNotNull() & F.col("at").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    own = good.groupBy("series", "at").agg(F.max("value").alias("value"))
    along = Window.partitionBy("series").orderBy("at")
    before = F.lag("value").over(along)
    lost = own.withColumn("lost", F.when(F.col("value") < before, before).otherwise(0.0))
    return lost.select("series", "at", "value", (F.col("value") + F.sum("lost").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("total"))


def rates(samples: DataFrame, width: int, step: int) -> DataFrame:
    """series, end, increase, rate of a counter in windows of ``width`` that end at each multiple of ``step`` (in the unit of ``at``, whole numbers).

    A window holds the samples with end - width < at <= end, and needs two of them. The increase between the first and the last is carried on to the window's
    edges, as far as they lie within 1.1 mean distances of a sample, else by half of one, and back no further than to
    where the counter would have been zero. ``rate`` is the increase by the unit.
    """
    own = corrected(samples)
    ends = F.sequence(F.ceil(F.col("at") / step) * step, F.floor((F.col("at") + width - 1) / step) * step, F.lit(step).cast("long"))
    has = F.floor((F.col("at") + width - 1) / step) >= F.ceil(F.col("at") / step)
    spread = own.where(has).withColumn("end", F.explode(ends))
    per = spread.groupBy("series", "end").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("value", "at").alias("start_value"), (F.max_by("total", "at") - F.min_by("total", "at")).alias("delta"))
    per = per.where("n > 1").withColumn("span", (F.col("last") - F.col("first")).cast("double"))
    mean = F.col("span") / (F.col("n") - 1)
    edge = lambda gap: F.when(gap < mean * REACH, gap).otherwise(mean * HALF)
    back = edge(F.col("first") - (F.col("end") - width))
    to_zero = F.when((F.col("delta") > 0) & (F.col("start_value") >= 0), F.col("span") * F.col("start_value") / F.col("delta"))
    reach = F.col("span") + F.least(back, to_zero) + edge(F.col("end") - F.col("last"))
    return per.select("series", "end", (F.col("delta") * reach / F.col("span")).alias("increase"), (F.col("delta") * reach / F.col("span") / width).alias("rate"))


def bucket_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """key, quantile of ``buckets`` (key, bound, count): counts of values up to each bound, of which the greatest is infinite.

    The quantile lies in the first bucket that holds it, between its bounds by the share of its values; below the first
    bound it starts from 0 (or is that bound, if not positive), and in the infinite bucket it is the last finite bound. Counts that fall
    from bound to bound are levelled up. Without values, an infinite or a finite bound there is no row.
    """
    own = buckets.where("key IS NOT NULL AND bound IS NOT NULL AND count IS NOT NULL").groupBy("key", "bound").agg(F.sum("count").alias("count"))
    along = Window.partitionBy("key").orderBy("bound")
    own = own.withColumn("count", F.max("count").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("key")
    own = own.withColumns({"below": F.coalesce(F.lag("count").over(along), F.lit(0)), "low": F.lag("bound").over(along), "all": F.max("count").over(whole), "top": F.max("bound").over(whole)})
    rank = F.col("all") * q
    held = own.where((F.col("top") == float("inf")) & (F.col("all") > 0) & (F.col("count") >= rank)).groupBy("key").agg(F.min_by(F.struct("bound", "low", "below", "count", "all"), "bound").alias("b"))
    bound, low = F.col("b.bound"), F.col("b.low")
    start = F.coalesce(low, F.lit(0.0))
    share = (F.col("b.all") * q - F.col("b.below")) / (F.col("b.count") - F.col("b.below"))
    value = F.when(bound == float("inf"), low).when(low.isNull() & (bound <= 0), bound).otherwise(start + (bound - start) * F.coalesce(share, F.lit(0.0)))
    return held.select("key", value.alias("quantile")).where(F.col("quantile").isNotNull())
