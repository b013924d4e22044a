"""Fair shares of a limit among groups of unequal supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allotments(supplies: DataFrame, limit: int) -> DataFrame:
    """``supplies`` (base, supply) with allotted: the max-min fair share of ``limit``.

    With supplies in ascending order, the level is what is left for each of the bases that
    are not yet used up: the first at which the next base has enough. Every base gets the level or all it has; the
    few that are left over go one each to the first bases, by name (null first), that have more. The table has a
    row for each base, which is taken to be small.
    """
    order = Window.orderBy("supply", "base")
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.floor((F.lit(limit) - before) / F.count(F.lit(1)).over(order.rowsBetween(0, Window.unboundedFollowing)))
    levelled = supplies.where("supply > 0").withColumn("share", share)
    enough = F.when(F.col("share") <= F.col("supply"), F.struct("supply", F.col("base").isNotNull().alias("named"), "base", F.greatest("share", F.lit(0)).alias("share")))
    level = F.min(enough).over(Window.partitionBy())["share"]
    levelled = levelled.withColumn("level", F.coalesce(level, F.lit(limit)))
    even = levelled.withColumn("even", F.least("supply", "level"))
    more = F.row_number().over(Window.partitionBy(F.col("supply") > F.col("level")).orderBy("base"))
    left = F.lit(limit) - F.sum("even").over(Window.partitionBy())
    extra = F.when((F.col("supply") > F.col("level")) & (more <= left), 1).otherwise(0)
    return even.select("base", "supply", (F.col("even") + extra).cast("long").alias("allotted"))


def select_fairly(items: DataFrame, limit: int, order: list, per_document: int = 2) -> DataFrame:
    """At most ``limit`` ``items`` (base, document_id), shared fairly over bases: their columns with position in the base.

    Of a document ``per_document`` items count at most, the first in ``order``; a base gives
    its first ones, documents' first items before any second. A null base is a base.
    """
    first = F.row_number().over(Window.partitionBy("base", "document_id").orderBy(*order))
    capped = items.withColumn("turn_", first).where(F.col("turn_") <= per_document)
    shares = allotments(capped.groupBy("base").agg(F.count(F.lit(1)).alias("supply")), limit).withColumnRenamed("base", "base_")
    placed = capped.withColumn("position", F.row_number().over(Window.partitionBy("base").orderBy("turn_", *order)))
    kept = placed.join(shares, F.col("base").eqNullSafe(F.col("base_"))).where(F.col("position") <= F.col("allotted"))
    return kept.select(*items.columns, "position")
