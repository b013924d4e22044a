"""Reranking, parent contexts, coverage of requirements, strict citations, and balanced picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import citations
from corvane.operators.greedy import Spread, streamed


def rerank(ranked: DataFrame, score: Column, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each query by a scorer: adds score, reranked and final_rank.

    ``ranked`` has query_id, chunk_id, rank and what ``score`` reads; any
    expression scores, :func:`corvane.functions.text.term_overlap` of question
    and text for one. No score is too low. A scorer fails for the whole query
    if it gives null for a candidate: the query then keeps its fused order,
    with null scores. Ties keep the fused order.
    """
    works = F.bool_and(F.col("score").isNotNull()).over(Window.partitionBy("query_id"))
    scored = ranked.withColumn("score", score).withColumn("reranked", works).withColumn("score", F.when(F.col("reranked"), F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank", "chunk_id")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit)


def load_parents(children: DataFrame, parents: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """The contexts of the ``limit`` parents with the best children of each query, in that order.

    ``children``: query_id, chunk_id, parent_id, score, text; ``parents``:
    parent_id, text; ``blocks``: parent_id, ord, page, heading. Returns
    query_id, parent_id, parent_rank, score (the best child's), text, anchors
    (start and end of each child whose text stands just once in the parent),
    provenance (all children with their scores), first_page, last_page and
    heading (the first there is). A parent that isn't in ``parents`` counts to
    the limit but gives no row. Children without a parent take no part.
    """
    own = children.where(F.col("parent_id").isNotNull())
    best = own.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"))
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    first = best.withColumn("parent_rank", F.row_number().over(line)).where(F.col("parent_rank") <= limit)
    loaded = first.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id")
    told = loaded.join(own.select("query_id", "parent_id", "chunk_id", F.col("score").alias("child_score"), "text"), ["query_id", "parent_id"])
    place = F.expr("locate(text, parent_text)")
    once = (F.col("place") > 0) & (F.expr("locate(text, parent_text, place + 1)") == 0)
    anchor = F.when(once, F.struct("chunk_id", (F.col("place") - 1).alias("start"), (F.col("place") - 1 + F.length("text")).alias("end")))
    told = told.withColumn("place", place).withColumn("anchor", anchor)
    contexts = told.groupBy("query_id", "parent_id", "parent_rank", "score", F.col("parent_text").alias("text")).agg(
        F.sort_array(F.collect_list("anchor")).alias("anchors"), F.sort_array(F.collect_list(F.struct((-F.col("child_score")).alias("order"), "chunk_id", F.col("child_score").alias("score")))).alias("provenance")
    )
    contexts = contexts.withColumn("provenance", F.transform("provenance", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))))
    spans = blocks.groupBy("parent_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("ord"))).alias("heading"))
    return contexts.join(spans, "parent_id", "left")


def coverage(requirements: DataFrame, decisions: DataFrame, cited: DataFrame, offered: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row for each goal: run_id, goal_id, requirements, missing, degraded, state.

    ``requirements``: run_id, goal_id, requirement_id; ``decisions`` the same
    with the judge's status; ``cited`` and ``offered`` the same with
    evidence_id; ``repaired``: run_id of runs whose one repair is over. A
    judgement holds if every requirement of the run has just one decision and
    no other is decided, what is COVERED cites evidence that was offered for
    it, and what is MISSING cites none. Otherwise the run is degraded, and all
    its requirements are missing. A goal without a missing requirement is
    SATISFIED_LOCKED; others need repair, or have exhausted it.
    """
    key = ["run_id", "goal_id", "requirement_id"]
    known = offered.select(*key, "evidence_id", F.lit(True).alias("known")).distinct()
    refs = cited.join(known, [*key, "evidence_id"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.col("known").isNull()).alias("n_strange"))
    judged = decisions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status")).join(refs, key, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    covered = (F.col("status") == "COVERED") & (n("n_cited") > 0) & (n("n_strange") == 0)
    sound = F.coalesce(F.col("asked") & (n("n") == 1) & (covered | ((F.col("status") == "MISSING") & (n("n_cited") == 0))), F.lit(False))
    each = requirements.select(*key).distinct().withColumn("asked", F.lit(True)).join(judged, key, "full")
    each = each.select(*key, "asked", F.coalesce(covered, F.lit(False)).alias("covered"), sound.alias("sound"))
    broken = each.groupBy("run_id").agg((~F.bool_and("sound")).alias("degraded"))
    goals = each.where("asked").groupBy("run_id", "goal_id").agg(F.count(F.lit(1)).alias("requirements"), F.count_if(~F.col("covered")).alias("open"))
    out = goals.join(broken, "run_id").join(repaired.select("run_id", F.lit(True).alias("done")).distinct(), "run_id", "left")
    out = out.withColumn("missing", F.when(F.col("degraded"), F.col("requirements")).otherwise(F.col("open")))
    state = F.when(F.col("missing") == 0, "SATISFIED_LOCKED").when(F.col("done"), "REPAIR_EXHAUSTED").otherwise("NEEDS_REPAIR")
    return out.select("run_id", "goal_id", "requirements", "missing", "degraded", state.alias("state"))


def strict_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Which answers fail: answer_id, cited, invalid, failed.

    ``answers``: answer_id, answer; ``evidence``: answer_id, mark (E1, E2, ...),
    valid. An answer without a citation fails, and so does one with a citation
    that isn't evidence of it or isn't valid any more.
    """
    marks = answers.select("answer_id", F.explode_outer(citations(F.coalesce("answer", F.lit("")))).alias("mark"))
    held = evidence.groupBy("answer_id", "mark").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("valid"))
    out = marks.join(held, ["answer_id", "mark"], "left").groupBy("answer_id").agg(F.count("mark").alias("cited"), F.count_if(F.col("mark").isNotNull() & ~F.coalesce("valid", F.lit(False))).alias("invalid"))
    return out.withColumn("failed", (F.col("cited") == 0) | (F.col("invalid") > 0))


def balanced_pick(candidates: DataFrame, count: int) -> DataFrame:
    """``count`` items of each group, spread over kinds and documents: group_id, position, item_id.

    ``candidates``: group_id, item_id, kind, documents (a list), rank (any
    order). The next item is of the kind taken least so far, then has the
    documents taken least, then the lowest rank and id. All of a smaller group
    is taken. Of items alike in kind and documents only the first ``count`` can
    be taken, and where every item has one document, only those of a kind's
    first ``count`` documents, as at most ``count - 1`` are taken before: a
    task gets no others. It reads them as a stream and holds what could still be taken (:class:`Spread`).
    """
    same = ["group_id", "kind", "documents"]
    rows = candidates.select("group_id", "item_id", "kind", F.sort_array(F.coalesce("documents", F.array().cast("array<string>"))).alias("documents"), "rank")
    near = rows.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("rank", "item_id"))).where(F.col("n") <= count)
    sets = near.where("n = 1").withColumn("place", F.row_number().over(Window.partitionBy("group_id", "kind").orderBy("rank", "item_id")))
    widest = rows.groupBy("group_id").agg(F.max(F.abs(F.size("documents") - 1)).alias("off_one"))
    open_sets = sets.join(widest, "group_id").where((F.col("off_one") > 0) | (F.col("place") <= count)).select(*[F.col(c).alias(f"s_{c}") for c in same])
    alike = (F.col("s_group_id") == F.col("group_id")) & F.col("kind").eqNullSafe(F.col("s_kind")) & (F.col("s_documents") == F.col("documents"))
    bounded = near.join(open_sets, alike, "left_semi").drop("n")

    width = rows.groupBy(F.col("group_id").alias("g_")).agg(F.max(F.size("documents")).alias("widest"))
    bounded = bounded.join(width, F.col("group_id").eqNullSafe(F.col("g_"))).drop("g_")
    return streamed(bounded, "group_id", ["rank", "item_id"], lambda: Spread(count), "group_id string, position int, item_id long")
