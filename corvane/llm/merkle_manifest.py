"""Merkle manifest of a table: digests of its rows, of groups of them and of the whole, with a proof for each row.

The trees are built from the bottom up, each level a persisted table in which
two neighbours become their parent, and proofs are pushed from the top down: the
children of a level join their parents, and each puts its sibling's digest before the proof that
its parent has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: Bits of a row's place in its partition in an increasing id of Spark (a fixed value).
PLACE_BITS = 33
#: Where a node's sibling stands: before it, after it, or nowhere.
BEFORE, AFTER, NONE = "L", "R", "-"
WIDTH = 32


def field(value: Column) -> Column:
    """A value as it enters a leaf: UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values' fields, joined; binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with idx, the place of a row in its group, and n, the rows of that group.

    Rows are dealt by ranges of group, ``order`` and a number drawn for each row, so neither a large group nor a
    thousand equal rows fall into one task. A row's place is that in its
    partition on top of the counts of the group's partitions before.
    """
    drawn = df.withColumn("draw_", F.rand(11)).repartitionByRange(group, *order, "draw_").sortWithinPartitions(group, *order, "draw_")
    placed = materialize(drawn.drop("draw_").withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", PLACE_BITS)))
    counts = placed.groupBy(F.col(group).alias("group_"), F.col("part_").alias("p_")).agg(F.count(F.lit(1)).alias("c_"), F.min("at_").alias("first_"))
    along = Window.partitionBy("group_").orderBy("p_")
    starts = counts.select("group_", "p_", "first_", F.sum("c_").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("base_") - F.col("c_"), F.sum("c_").over(Window.partitionBy("group_")).alias("n"))
    starts = starts.toDF("group_", "p_", "first_", "base_", "n")
    out = placed.join(starts, placed[group].eqNullSafe(starts["group_"]) & (placed["part_"] == starts["p_"]))
    return out.withColumn("idx", F.col("base_") + F.col("at_") - F.col("first_")).drop("at_", "part_", "group_", "p_", "first_", "base_")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of ``nodes`` (tree, idx, n, digest): tree, idx, n, digest, left, right. A last child without a neighbour is hashed alone."""
    low = F.col("idx") % 2 == 0
    pairs = nodes.where(F.col("n") > 1).groupBy("tree", F.floor(F.col("idx") / 2).alias("idx"), F.ceil(F.col("n") / 2).alias("n"))
    both = pairs.agg(F.max(F.when(low, F.col("digest"))).alias("left"), F.max(F.when(~low, F.col("digest"))).alias("right"))
    digest = F.unhex(F.sha2(F.concat(hex_text(F.col("left")), F.coalesce(hex_text(F.col("right")), F.lit(""))).cast("binary"), 256))
    return both.select("tree", "idx", "n", digest.alias("digest"), "left", "right")


def build(nodes: DataFrame) -> list[DataFrame]:
    """All levels of the trees of ``nodes`` (tree, idx, n, digest), from the leaves on; each but the first is a table of its own.

    The number of levels follows from the largest n, which is all that reaches the driver.
    """
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialize(parents(levels[-1])))
        most = (most + 1) // 2
    return levels


def push(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first level with subroot, proof and sides: the siblings from a node up, and at each step where the sibling stands.

    ``tops`` has tree, top_proof and top_sides, those of the tree's root in what is above it. Every
    level is persisted, and its children join it by their parent's place.
    """
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].columns
        roots = levels[k].where(F.col("n") == 1).join(tops, "tree")
        out = roots.select(*own, F.col("digest").alias("subroot"), F.col("top_proof").alias("proof"), F.col("top_sides").alias("sides"))
        if above is not None:
            joined = levels[k].where(F.col("n") > 1).withColumn("up", F.floor(F.col("idx") / 2)).join(above, ["tree", "up"])
            low = F.col("idx") % 2 == 0
            sibling = F.when(low, F.col("up_right")).otherwise(F.col("up_left"))
            side = F.when(~low, BEFORE).when(F.col("up_right").isNull(), NONE).otherwise(AFTER)
            proof, sides = F.concat(F.coalesce(sibling, F.lit(b"")), F.col("up_proof")), F.concat(side, F.col("up_sides"))
            out = out.unionByName(joined.select(*own, F.col("up_subroot").alias("subroot"), proof.alias("proof"), sides.alias("sides")))
        if k == 0:
            return out
        ups = {"idx": "up", "left": "up_left", "right": "up_right", "subroot": "up_subroot", "proof": "up_proof", "sides": "up_sides"}
        above = materialize(out.select("tree", *[F.col(c).alias(u) for c, u in ups.items()]))
    raise ValueError("no levels")


def fold(leaf: Column, proof: Column, sides: Column) -> Column:
    """The root that a leaf and its proof give, as hex text."""

    def step(acc: Column, i: Column) -> Column:
        side = F.substr(sides, i, F.lit(1))
        sibling = hex_text(F.substr(proof, acc["at"] * WIDTH + 1, F.lit(WIDTH)))
        joined = F.concat(F.when(side == BEFORE, sibling).otherwise(""), acc["digest"], F.when(side == AFTER, sibling).otherwise(""))
        return F.struct(F.sha2(joined.cast("binary"), 256).alias("digest"), (acc["at"] + F.when(side == NONE, 0).otherwise(1)).alias("at"))

    start = F.struct(hex_text(leaf).alias("digest"), F.lit(0).alias("at"))
    steps = F.when(F.length(sides) > 0, F.sequence(F.lit(1), F.length(sides))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc["digest"])


def manifest(df: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """id, group, leaf, subroot, root, proof, sides and, with ``altered``, altered_leaf for each row of ``df``.

    A leaf is the SHA-256 of ``columns`` (doc_id, source, lang, n_chars, text), each as :func:`field` writes it.
    In each group the leaves stand by id (null first; rows of one id by their leaves), every two neighbours make a
    node, a last one without a neighbour is hashed alone, and so on to the group's subroot, which is the leaf
    itself if it is alone. The subroots, by group (null first, by UTF-8 bytes), make the root alike. All digests are
    binary and go into others as hex text. ``proof`` is the siblings' digests
    from the leaf up, ``sides`` a letter for each step; :func:`fold` goes
    that way back. ``altered`` names columns with other values, and
    altered_leaf is the leaf with them (null where a row's leaf is the same).

    Null values have a leaf like others; a null group is a group, first of all. Repeated rows have a leaf each.
    Texts of any length are hashed whole where they are read, and only digests move. An empty table gives no rows;
    other columns play no part, whatever their names. A group of any size is
    spread by ranges, and its levels by parents.
    """
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    own = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *_altered(columns, altered or {}))
    leaves = materialize(numbered(materialize(own), "group", ["id", "digest"]))
    groups = numbered(leaves.groupBy("group").agg(F.max("n").alias("rows")).withColumn("all", F.lit(0)), "all", ["group"])
    groups = materialize(groups.select(F.col("group").alias("g"), F.col("idx").alias("tree"), F.col("n").alias("trees")))
    first = leaves.join(groups, F.col("group").eqNullSafe(F.col("g"))).drop("g", "trees")
    levels = build(materialize(first))
    roots = levels[0].select("tree", "n", "digest").where(F.col("n") == 1)
    for level in levels[1:]:
        roots = roots.unionByName(level.select("tree", "n", "digest").where(F.col("n") == 1))
    subroots = roots.select("tree", "digest").join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest")
    upper = build(materialize(subroots))
    nothing = df.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(b"").alias("top_proof"), F.lit("").alias("top_sides"))
    tops = materialize(push(upper, nothing).select(F.col("idx").alias("tree"), F.col("subroot").alias("root"), F.col("proof").alias("top_proof"), F.col("sides").alias("top_sides")))
    proven = push(levels, tops.drop("root"))
    root = tops.limit(1).select("root").first()
    out = proven.select("id", "group", F.col("digest").alias("leaf"), "subroot", F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"), "proof", "sides", *(["altered_leaf"] if altered else []))
    return out


def _altered(columns: list[str], altered: dict[str, Column]) -> list[Column]:
    if not altered:
        return []
    values = [altered.get(c, F.col(c)) for c in columns]
    same = F.lit(True)
    for c, v in altered.items():
        same = same & F.col(c).eqNullSafe(v)
    return [F.when(~same, leaf_digest(values)).alias("altered_leaf")]


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`manifest` with folded_root, from the altered leaf where there is one, and whether it is the root."""
    leaf = F.coalesce("altered_leaf", "leaf") if "altered_leaf" in rows.columns else F.col("leaf")
    folded = rows.withColumn("folded_root", fold(leaf, F.col("proof"), F.col("sides")))
    return folded.withColumn("verified", F.col("folded_root") == hex_text(F.col("root")))
