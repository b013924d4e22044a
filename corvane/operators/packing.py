"""Token-bounded evidence packs."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import canonical_space, packing_tokens
from corvane.operators.greedy import Chooser, Cover, Fill, Fits, Trim, Varied, streamed


def pack_in_order(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """Greedy packs in rank order: query_id, evidence (from 1), chunk_id, text, tokens.

    Blank texts, repeated chunks and texts that repeat one before (whatever
    their case and spacing) are left out; an item over what is left is skipped
    and the next is tried; an oversize first item is cut. The fold runs over a
    query's items, which are as few as a ranked list is long.
    """
    text = canonical_space(F.coalesce("text", F.lit("")))
    own = hits.select("query_id", "rank", "chunk_id", text.alias("text")).where(F.col("text") != "")
    for key in (F.col("chunk_id"), F.lower("text")):
        own = own.withColumn("key", key)
        own = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank", "chunk_id"))).where("n = 1").drop("n", "key")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")) == 1
    own = own.withColumn("first", first)
    own = own.withColumn("text", F.when(F.col("first") & (packing_tokens(F.col("text")) > budget), F.substring("text", 1, max(400, 2 * budget))).otherwise(F.col("text")))
    own = own.withColumn("tokens", packing_tokens(F.col("text")))
    items = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "tokens", "text"))).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,chunk_id:bigint,tokens:bigint,text:string>>").alias("taken"))

    def step(state, x):
        fits = (F.size(state["taken"]) == 0) | (state["used"] + x["tokens"] <= budget)
        item = F.struct(x["rank"].cast("int").alias("rank"), x["chunk_id"].cast("long").alias("chunk_id"), x["tokens"].alias("tokens"), x["text"].alias("text"))
        return F.when(fits, F.struct((state["used"] + x["tokens"]).alias("used"), F.concat(state["taken"], F.array(item)).alias("taken"))).otherwise(state)

    packed = items.select("query_id", F.aggregate("items", empty, step)["taken"].alias("taken"))
    return packed.select("query_id", F.posexplode("taken").alias("evidence", "x")).select("query_id", (F.col("evidence") + 1).alias("evidence"), "x.chunk_id", "x.text", "x.tokens")


def _parents(evidence: DataFrame) -> DataFrame:
    """run_id, parent_id, score, tokens, goals and needs; parents of unknown size can't be packed."""
    need = F.when(F.col("goal_id").isNotNull() & F.col("requirement_id").isNotNull(), F.concat_ws("/", "goal_id", "requirement_id"))
    return evidence.groupBy("run_id", "parent_id").agg(
        F.max("score").cast("double").alias("score"), F.max("tokens").cast("long").alias("tokens"), F.sort_array(F.collect_set(F.col("goal_id").cast("string"))).alias("goals"), F.sort_array(F.collect_set(need)).alias("needs")
    ).where("tokens IS NOT NULL")


def _best_first() -> list:
    return [F.desc_nulls_last("score"), F.asc("tokens"), F.col("parent_id").cast("string").asc()]


def pack_for_coverage(evidence: DataFrame, budget: int) -> DataFrame:
    """Packs of a run's parents that cover goals and requirements first: run_id, position, parent_id, tokens, score.

    ``evidence``: run_id, goal_id, requirement_id, parent_id, score, tokens.
    The parent that fits and gains most goes in (8 for each new goal, 3 for
    each new requirement; ties: score, fewer tokens, id) until none gains; what
    fits then follows in that order. If nothing fits, the smallest goes in.
    Null goals and requirements gain nothing, a parent of unknown size takes no part, and a null run is a run.
    A run's parents are read as two streams: the first finds what gains, the second what still fits.
    """
    parents = _parents(evidence)
    kind = f"run_id {parents.schema['run_id'].dataType.simpleString()}"
    key = parents.schema["parent_id"].dataType.simpleString()
    gained = streamed(parents, "run_id", _best_first(), lambda: Cover(budget, 8, 3), f"{kind}, chosen array<{key}>, used long")
    rows = parents.select("run_id", "parent_id", "score", "tokens", F.lit(None).cast(f"array<{key}>").alias("chosen"), F.lit(None).cast("long").alias("used"))
    both = rows.unionByName(gained, allowMissingColumns=True)
    return streamed(both, "run_id", [F.col("chosen").isNull(), *_best_first()], lambda: Fill(budget), f"{kind}, position int, parent_id {key}, tokens long, score double")


def accept_within_quotas(arrivals: DataFrame, total: int, per_goal: int, per_parent: int, per_requirement: int | None = None) -> DataFrame:
    """What an evidence pool accepts, in the order of arrival: run_id, seq, goal_id, span_id, decision, linked.

    ``arrivals``: run_id, seq, goal_id, span_id, parent_id, phase. A span that
    its goal has already is a REPEAT; a full pool, goal or parent (in its
    phase) rejects by QUOTA. With ``per_requirement``, arrivals also have
    ``requirements``, a list of longs: links to requirements that have so many
    spans are trimmed, a span left without any is rejected, and a span that
    comes again with another phase or requirement is MERGED into the one its
    goal holds. ``linked`` are the span's requirements then (null if it is
    rejected). Each task streams through its runs in order and holds what one
    run has accepted, which ``total`` bounds. A null run is a run, and null goals, spans, parents
    and phases are values like others; null requirements count for nothing.
    """
    linked = per_requirement is not None
    columns = ["run_id", "seq", "goal_id", "span_id", "parent_id", "phase"]
    own = arrivals.select(*columns, *(["requirements"] if linked else []))

    class Pool(Chooser):
        """What a run has accepted: its spans' phases and links, and how many each goal, parent and requirement has."""

        def __init__(self):
            self.pool, self.goals, self.spots, self.needs = {}, Counter(), Counter(), Counter()

        def take(self, r: dict) -> list[tuple]:
            goal, needs = r["goal_id"], self.needs
            key, spot = (goal, r["span_id"]), (goal, r["parent_id"], r["phase"])
            held = self.pool.get(key)
            asked = {q for q in r["requirements"] or () if q is not None} if linked else set()
            wanted = asked | (held[1] if held else set())
            free = {q for q in wanted if needs[goal, q] < per_requirement} if linked else set()
            full = held is None and (len(self.pool) >= total or self.goals[goal] >= per_goal or self.spots[spot] >= per_parent)
            if held and (not linked or (asked <= held[1] and held[0] == r["phase"])):
                decision, links = "REPEAT", held[1]
            elif full or (linked and not free):
                decision, links = "QUOTA", None
            else:
                decision, links = ("MERGED" if held else "ACCEPTED"), free
                if not held:
                    self.goals[goal] += 1
                    self.spots[spot] += 1
                needs.subtract((goal, q) for q in (held[1] if held else ()))
                needs.update((goal, q) for q in free)
                self.pool[key] = (held[0] if held else r["phase"], free)
            return [(r["run_id"], r["seq"], goal, r["span_id"], decision, sorted(links) if linked and links is not None else None)]

    return streamed(own, "run_id", ["seq", "goal_id", "span_id"], Pool, "run_id long, seq long, goal_id long, span_id long, decision string, linked array<long>")


def diversify(candidates: DataFrame, limit: int, threshold: float = 0.72) -> DataFrame:
    """A varied choice of a group's questions: those of a new kind first, then the rest, none too similar to one chosen.

    ``candidates``: group_id, item_id, kind, pairs (distinct character pairs),
    documents, quality. Order: documents, quality, id. Groups of any size are read as two streams, of which the
    second has the first one's choice before it; a task holds ``limit`` items of a group.
    """
    rows = candidates.select("group_id", "item_id", "kind", "pairs", "documents", "quality", F.lit(None).cast("int").alias("place"))
    order = [F.desc_nulls_last("documents"), F.desc_nulls_last("quality"), F.asc("item_id")]
    types = {c: rows.schema[c].dataType.simpleString() for c in ("group_id", "item_id", "kind", "pairs")}
    schema = f"group_id {types['group_id']}, position int, item_id {types['item_id']}, kind {types['kind']}, pairs {types['pairs']}"
    fresh = streamed(rows, "group_id", order, lambda: Varied(limit, threshold, True), schema)
    before = fresh.select("group_id", "item_id", "kind", "pairs", F.col("position").alias("place"))
    rest = streamed(rows.unionByName(before, allowMissingColumns=True), "group_id", [F.asc_nulls_last("place"), *order], lambda: Varied(limit, threshold, False), schema)
    return fresh.unionByName(rest).select("group_id", "position", "item_id")


def round_robin(children: DataFrame, limit: int) -> DataFrame:
    """Spans one parent after the other by depth, each span once: query_id, position, span_id."""
    deep = children.withColumn("depth", F.row_number().over(Window.partitionBy("query_id", "parent_rank").orderBy("rank", "span_id")))
    once = deep.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "span_id").orderBy("depth", "parent_rank"))).where("n = 1")
    line = Window.partitionBy("query_id").orderBy("depth", "parent_rank")
    return once.withColumn("position", F.row_number().over(line)).where(F.col("position") <= limit).select("query_id", "position", "span_id")


def trim_packs(evidence: DataFrame, budget: int) -> DataFrame:
    """All parents of a run by score, without those at the end that its budget has no room for: run_id, position, parent_id, tokens.

    While the pack is over ``budget``, the last parent all of whose goals and
    requirements others cover too goes; if there is none, the rest stays.
    ``evidence`` is that of :func:`pack_for_coverage`.
    """
    parents = _parents(evidence)
    kind, key = parents.schema["run_id"].dataType.simpleString(), parents.schema["parent_id"].dataType.simpleString()
    times = parents.select("run_id", F.explode("needs").alias("need")).groupBy("run_id", "need").agg(F.count(F.lit(1)).alias("times"))
    cover = times.groupBy("run_id").agg(F.collect_list(F.struct("need", "times")).alias("cover")).withColumnRenamed("run_id", "r_")
    heads = parents.groupBy("run_id").agg(F.sum("tokens").alias("total")).join(cover, F.col("run_id").eqNullSafe(F.col("r_")), "left")
    heads = heads.select("run_id", "total", F.coalesce("cover", F.array().cast(cover.schema["cover"].dataType)).alias("cover"))
    both = parents.unionByName(heads, allowMissingColumns=True)
    from_the_end = [F.col("cover").isNull(), F.asc_nulls_first("score"), F.desc("tokens"), F.col("parent_id").cast("string").desc()]
    kept = streamed(both, "run_id", from_the_end, lambda: Trim(budget), f"run_id {kind}, parent_id {key}, tokens long, score double")
    position = F.row_number().over(Window.partitionBy("run_id").orderBy(*_best_first()))
    return kept.select("run_id", position.alias("position"), "parent_id", "tokens")


def fit_in_order(items: DataFrame, group: str, order: list, budget: int) -> DataFrame:
    """``items`` that fit, in order, what is left of their group's ``budget`` of tokens, with their position: group's ranges of any size are streams."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields) + ", position int"
    columns = items.columns
    return streamed(items, group, order, lambda: Fits(budget, columns), schema)
