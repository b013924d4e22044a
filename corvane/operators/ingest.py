"""Incremental ingestion: differences of versions, reuse by content, publishing, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(all_rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What has no counterpart yet."""
    return all_rows.join(present.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The table with the last change of each key in place of what it held."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = changes.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it lacks; of rows with one key, one."""
    return table.unionByName(missing(rows.dropDuplicates(keys), table, keys))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of two versions (document_id, position, hash): what became of each.

    A new chunk whose hash the old version has is UNCHANGED, wherever it
    stands; else one at an old position is MODIFIED, and one beyond is ADDED. An
    old chunk is REMOVED if the new version has neither its hash nor its place.
    """
    keys = ["document_id"]
    old_hashes = old.select(*keys, "hash").distinct().withColumn("had_hash", F.lit(True))
    old_places = old.select(*keys, "position").distinct().withColumn("had_place", F.lit(True))
    now = new.join(old_hashes, [*keys, "hash"], "left").join(old_places, [*keys, "position"], "left")
    state = F.when(F.col("had_hash"), "UNCHANGED").when(F.col("had_place"), "MODIFIED").otherwise("ADDED")
    gone = old.join(new.select(*keys, "hash").distinct(), [*keys, "hash"], "left_anti").join(new.select(*keys, "position").distinct(), [*keys, "position"], "left_anti")
    return now.select(*keys, "position", "hash", state.alias("change")).unionByName(gone.select(*keys, "position", "hash", F.lit("REMOVED").alias("change")))


def reuse_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without an embedding that another chunk of equal content has: chunk_id, from_chunk_id.

    ``chunks``: chunk_id, hash, policy. The donors are reduced to one for each
    content before the join, so a text with many copies costs one row.
    """
    have = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_semi").groupBy("hash", "policy").agg(F.min("chunk_id").alias("from_chunk_id"))
    lack = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")
    return lack.join(have, ["hash", "policy"]).select("chunk_id", "from_chunk_id")


def covered(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Whether each generation embeds every chunk: generation, n_vectors, complete."""
    n = chunks.agg(F.count_distinct("chunk_id").alias("n_chunks"))
    own = embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi").groupBy("generation").agg(F.count_distinct("chunk_id").alias("n_vectors"))
    return own.join(F.broadcast(n)).select("generation", "n_vectors", (F.col("n_vectors") == F.col("n_chunks")).alias("complete"))  # one row


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key (latest version, job, artifact)."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def publish(versions: DataFrame, order: list) -> DataFrame:
    """Versions with their state after publishing: the newest ready one of a document is PUBLISHED, older published ones SUPERSEDED."""
    ready = F.col("state").isin("READY", "PUBLISHED")
    rank = F.row_number().over(Window.partitionBy("document_id", ready).orderBy(*order))
    return versions.withColumn("new_state", F.when(ready & (rank == 1), "PUBLISHED").when(F.col("state") == "PUBLISHED", "SUPERSEDED").otherwise(F.col("state")))


def expire(documents: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """Active documents with whether their current version has run out: document_id, new_status."""
    current = versions.where("is_current").select("document_id", "valid_to")
    over = F.coalesce(F.col("valid_to") <= at, F.lit(False))
    return documents.where(F.col("status") == "ACTIVE").join(current, "document_id", "left").select("document_id", F.when(over, "EXPIRED").otherwise("ACTIVE").alias("new_status"))


def removable(versions: DataFrame, references: DataFrame, before: Column) -> DataFrame:
    """Superseded versions from before a time that no citation or evidence refers to."""
    old = versions.where((F.col("state") == "SUPERSEDED") & (F.col("updated_at") < before))
    return old.join(references.select("version_id").distinct(), "version_id", "left_anti")


def map_offsets(blocks: DataFrame, separator: int = 2) -> DataFrame:
    """Blocks with source_start and source_end: running UTF-16 lengths with ``separator`` units between blocks."""
    units = F.length(F.encode("text", "UTF-16LE")) / 2
    own = blocks.withColumn("units", units.cast("long"))
    w = Window.partitionBy("document_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("units") + separator).over(w), F.lit(0))
    return own.withColumn("source_start", before).withColumn("source_end", before + F.col("units")).drop("units")


def locate_once(parents: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Pieces with the only place (from 0) at which their text stands in their parent's; null if absent or repeated."""
    met = pieces.join(parents.select(key, F.col("text").alias("whole")), key)
    first = F.expr("locate(text, whole)")
    again = F.expr("locate(text, whole, locate(text, whole) + 1)")
    return met.withColumn("start", F.when((first > 0) & (again == 0), first - 1)).drop("whole")


def content_revision(chunks: DataFrame) -> DataFrame:
    """A digest of each knowledge base's content, whatever the order of its chunks.

    The hashes are taken in 4096 parts by their first three digits; a part's digest
    is that of its ordered hashes, and the revision that of the ordered parts' digests,
    both joined by U+001F. So no base, however large, is one string.
    """
    joined = lambda c, by: F.sha2(F.expr(f"listagg({c}, char(31)) WITHIN GROUP (ORDER BY {by})").cast("binary"), 256)
    parts = chunks.groupBy("kb", F.substring("hash", 1, 3).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), joined("hash", "hash").alias("digest"))
    return parts.groupBy("kb").agg(F.sum("n").alias("n_chunks"), F.min("low").alias("min_hash"), F.max("high").alias("max_hash"), joined("digest", "part").alias("revision"))


def source_locations(chunks: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Where chunks stand in their document: chunk_id, page, source_start, source_end.

    ``chunks``: chunk_id, text, block_ids; ``blocks``: block_id, order_index, page,
    source_start, source_end, text; ``segments``: chunk_id, ord, block_id,
    source_start, source_end. Each value comes from the mapped segments (the
    first one's page, the first start, the last end), or else from the first of the chunk's
    blocks that holds its text, or else is the least page and start and the
    greatest end of its blocks. Only chunks that the segments leave a gap in
    meet their blocks' texts. Places that nothing tells are null.
    """
    page = blocks.select("block_id", "page")
    by = lambda c: F.when(F.col(c).isNotNull(), F.col("ord"))
    mapped = segments.join(page, "block_id", "left").groupBy("chunk_id").agg(
        F.min_by("page", F.when(F.col("block_id").isNotNull(), F.col("ord"))).alias("p1"), F.min_by("source_start", by("source_start")).alias("s1"), F.max_by("source_end", by("source_end")).alias("e1")
    )
    known = chunks.join(mapped, "chunk_id", "left")
    gap = F.col("p1").isNull() | F.col("s1").isNull() | F.col("e1").isNull()
    asked = known.where(gap).select("chunk_id", F.col("text").alias("chunk_text"), F.explode(F.array_distinct("block_ids")).alias("block_id"))
    met = asked.join(blocks, "block_id").withColumn("at", F.expr("locate(chunk_text, text)"))
    start = F.col("source_start") + F.col("at") - 1
    holds = F.when(F.col("at") > 0, F.struct("order_index", "block_id"))
    placed = F.when((F.col("at") > 0) & F.col("source_start").isNotNull(), F.struct("order_index", "block_id"))
    found = met.groupBy("chunk_id").agg(
        F.min_by("page", holds).alias("p2"), F.min_by(start, placed).alias("s2"), F.min_by(start + F.length("chunk_text"), placed).alias("e2"),
        F.min("page").alias("p3"), F.min("source_start").alias("s3"), F.max("source_end").alias("e3"),
    )
    out = known.join(found, "chunk_id", "left")
    return out.select("chunk_id", F.coalesce("p1", "p2", "p3").alias("page"), F.coalesce("s1", "s2", "s3").alias("source_start"), F.coalesce("e1", "e2", "e3").alias("source_end"))
