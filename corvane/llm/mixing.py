"""Mixing sources to target weights along a low-discrepancy schedule.

Multiples of the golden ratio, taken modulo one, run through the sources'
cumulative shares and give a sequence of slots in which every stretch holds each
source nearly in proportion. Slots are ranked in their source; the slot of rank
r takes the r-th block of the source's shuffled words, which are cut into blocks
of equal length, and begins anew after the last. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: 2^31 over the golden ratio, made odd, so that its multiples modulo 2^31 visit every value.
GOLDEN, PERIOD = 1327217885, 1 << 31
#: Cells of the unit interval by which slots and shares meet; slots counted together.
CELLS, CHUNK = 1024, 1 << 16


def count_words(text: str) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """A line for each source: src (its number), source, source_size, target.

    The sources by code point, null last, weigh ``weights`` in turn, and share
    ``volume`` times all words; no target passes ``most`` times its source's
    size. What is over goes to the others by weight: with the sources in the
    order in which they fill up, the level at which the rest is shared is the
    first that leaves the next one below its limit.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights) + 1))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.partitionBy()
    per = per.withColumn("total", F.lit(volume) * F.sum("source_size").over(everything))
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    return per.select("src", "source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def place_words(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """``sized`` with src, lo: where its words lie in its source's shuffled stream.

    The order is that of a digest of the id. Running sums are taken in 4096
    parts of each source, on top of the parts' totals, so that no task holds a
    large source.
    """
    own = sized.join(sources.select("src", F.col("source").alias("s_"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    own = own.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")))
    own = own.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    totals = own.groupBy("src", "bucket").agg(F.sum("size").alias("b"))
    along = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("src", "bucket", F.coalesce(F.sum("b").over(along), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("ends", F.sum("size").over(inside)).join(totals, ["src", "bucket"]).withColumn("lo", F.col("base") + F.col("ends") - F.col("size")).drop("h", "bucket", "ends", "base")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The mix as slots: position, src, block, pass, words, in the order of ``position``.

    Each source has as many slots as its target needs, the last of them cut
    short; a rank that the sequence gives too much is left out, and the few
    that it gives too little follow at the end.
    """
    spark = sources.sparkSession
    need = sources.withColumns({"need": F.floor("target").cast("long"), "nb": F.ceil(F.col("source_size") / block)})
    size, whole = F.col("source_size"), F.expr(f"need - (need div source_size) * source_size")
    need = need.where(size > 0).withColumn("slots", F.expr("need div source_size") * F.col("nb") + F.ceil(whole / block))
    n = need.agg(F.sum("slots")).first()[0] or 0
    along = Window.orderBy("src")
    shares = need.withColumns({
        "hi": F.sum("slots").over(along.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(max(n, 1))),
        "low": F.coalesce(F.sum("slots").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(float(max(n, 1))),
    })
    shares = materialize(shares)
    cells = shares.select("src", "low", "hi", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))).alias("cell"))
    points = spark.range(n).select("id", (((F.col("id") % PERIOD) * GOLDEN) % PERIOD / float(PERIOD)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = points.join(cells, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("hi"))).select("id", "src", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("c"))
    base = materialize(counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("id"))).join(base, ["src", "chunk"])
    ranked = ranked.select(F.col("id").alias("position"), "src", (F.col("base") + F.col("r") - 1).alias("rank"))
    given = base.groupBy("src").agg(F.sum("c").alias("given"))
    late = shares.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).where(F.col("given") < F.col("slots"))
    late = late.select("src", F.explode(F.sequence(F.col("given"), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.lit(n) + F.col("rank") * F.lit(1 << 20) + F.col("src")).alias("position"), "src", "rank")
    slots = ranked.unionByName(late).join(shares.drop("low", "hi"), "src").where(F.col("rank") < F.col("slots"))
    slots = slots.withColumns({"pass": F.floor(F.col("rank") / F.col("nb")), "block": F.col("rank") % F.col("nb")})
    done = F.col("pass") * F.col("source_size") + F.col("block") * block
    return slots.select("position", "src", "block", "pass", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("need") - done).alias("words"))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), volume: float = 1.5, most: float = 2.0, block: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix:", keys: dict[str, Column] | None = None) -> DataFrame:
    """What a mix of ``volume`` times all words takes of each document.

    Returns doc_id, source, size, source_size, target (its source's) and taken
    (words, repeats counted; at most ``most`` times size for a whole ``most``),
    with the columns that ``keys`` names. Reruns agree. A null text has no
    words and isn't taken; a null source is a source; rows with one id, or with
    none, are documents of their own; an empty table gives no rows; other
    columns play no part, whatever their names.
    """
    keys = keys or {}
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(text_col).alias("size"), *[c.alias(f"key_{k}") for k, c in keys.items()])
    sized = materialize(sized)
    sources = materialize(source_targets(sized, weights, volume, most))
    placed = materialize(place_words(sized, sources, seed))
    spans = placed.where(F.col("size") > 0).select("src", "lo", "size", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(lo + size - 1) div {block}"))).alias("block"))
    start = F.greatest(F.lit(0), F.col("lo") - F.col("block") * block)
    end = F.least(F.lit(block), F.col("lo") + F.col("size") - F.col("block") * block)
    met = spans.join(schedule(sources, block).select("src", "block", "words"), ["src", "block"])
    taken = met.groupBy("src", "lo").agg(F.sum(F.greatest(F.lit(0), F.least(end, F.col("words")) - start)).alias("taken"))
    out = placed.join(taken, ["src", "lo"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), *[F.col(f"key_{k}").alias(k) for k in keys])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as the mix takes them: each as often as the words taken make up whole copies, rounded.

    Rows that agree in id and text are one document here; they share evenly
    what the mix takes of them. The columns are those of ``docs``, whatever their names.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    share = mix(docs, id_col=id_col, text_col=text_col, keys={"digest": digest}, **options)
    times = share.groupBy("doc_id", "digest").agg(F.round(F.sum("taken") / F.greatest(F.lit(1), F.sum("size"))).cast("int").alias("times"))
    times = times.where(F.col("times") > 0)
    body = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"k{i}") for i, c in enumerate(docs.columns)}
    body = body.withColumn("own_digest", F.md5(F.coalesce(at[text_col], F.lit("")).cast("binary")))
    both = body.join(times, at[id_col].eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("digest")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[at[c].alias(c) for c in docs.columns])
