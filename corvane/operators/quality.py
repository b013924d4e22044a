"""Quality reports of parsed documents and of chunks, one line for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk that begins so was cut in the wrong place (fixed values).
SUSPICIOUS_START = r"^\s*[，。；：、！？,.;:!?)}\]\p{Pe}\p{Pf}]"
MARKUP = r"^(:::|---$|import .* from |<[A-Z]\w*)"
LOST = "�"


def _report(out: DataFrame, issues: list[tuple[str, str, int, Column]]) -> DataFrame:
    """Adds issues, score (from 100) and status by conditions, each with a severity and what it costs."""
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, _, _, cond in issues]))
    cost = sum((F.when(cond, F.lit(c)).otherwise(0) for _, _, c, cond in issues), F.lit(0))
    fails = F.lit(False)
    for _, severity, _, cond in issues:
        if severity == "FAIL":
            fails = fails | cond
    out = out.withColumns({"issues": codes, "score": F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost)).cast("int"), "failed": fails})
    return out.withColumn("status", F.when(F.col("failed"), "FAIL").when(F.size("issues") > 0, "WARNING").otherwise("PASS")).drop("failed")


def parse_quality(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A document's parse report from its blocks (document_id, order_index, type, text, page).

    ``pages`` holds (document_id, page_count) for paged formats. Page headers
    and footers don't count as content; repeats count among blocks of 24
    characters and more.
    """
    content = ~F.col("type").isin("PAGE_HEADER", "PAGE_FOOTER")
    text, n = F.col("text"), F.length("text")
    long = content & (n >= 24)
    joined_length = F.sum(n) + 2 * (F.count(F.lit(1)) - 1)
    out = blocks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(content).alias("content_blocks"),
        joined_length.alias("characters"),
        F.sum(F.length(F.regexp_replace(text, r"(?U)\s", ""))).alias("non_space"),
        F.sum(F.regexp_count(text, F.lit(LOST))).alias("lost"),
        F.count_if(long).alias("long_blocks"),
        F.count_distinct(F.when(long, F.sha2(text.cast("binary"), 256))).alias("distinct_long"),
        F.count_distinct(F.when(content, F.col("page"))).alias("covered_pages"),
        F.coalesce(F.max(F.when(content, n)), F.lit(0)).alias("largest"),
        F.count_if(content & F.col("type").isin("TITLE", "HEADING", "LIST", "TABLE", "CODE", "CAPTION")).alias("structured"),
        F.count_if(content & text.rlike(MARKUP)).alias("markup"),
    )
    out = out.join(pages, "document_id", "left") if pages is not None else out.withColumn("page_count", F.lit(0))
    out = out.withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    one = F.lit(1)
    out = out.withColumns({
        "lost_ratio": F.col("lost") / F.greatest(one, F.col("characters")),
        "duplicate_ratio": (F.col("long_blocks") - F.col("distinct_long")) / F.greatest(one, F.col("long_blocks")),
        "page_coverage": F.when(F.col("page_count") > 0, F.col("covered_pages") / F.col("page_count")).otherwise(F.lit(1.0)),
        "per_page": F.col("non_space") / F.greatest(one, F.col("page_count")),
        "structured_ratio": F.round(F.col("structured") / F.greatest(one, F.col("content_blocks")), 4),
    })
    c = F.col
    out = _report(out, [
        ("CONTENT_TOO_SHORT", "FAIL", 80, c("non_space") < 20),
        ("EXCESSIVE_REPLACEMENT_CHARACTERS", "FAIL", 60, c("lost_ratio") >= 0.02),
        ("REPLACEMENT_CHARACTERS_DETECTED", "WARNING", 20, (c("lost_ratio") >= 0.002) & (c("lost_ratio") < 0.02)),
        ("SPARSE_PDF_TEXT_LAYER", "WARNING", 30, (c("page_count") > 0) & ((c("page_coverage") < 0.6) | (c("per_page") < 80))),
        ("REPEATED_CONTENT", "WARNING", 20, c("duplicate_ratio") >= 0.35),
        ("OVERSIZED_BLOCK", "WARNING", 15, c("largest") > 50_000),
        ("SOURCE_MARKUP_LEAKAGE", "WARNING", 25, (c("page_count") > 0) & (c("markup") > 0)),
    ])
    return out.withColumns({"lost_ratio": F.round("lost_ratio", 6), "duplicate_ratio": F.round("duplicate_ratio", 4), "page_coverage": F.round("page_coverage", 4), "per_page": F.round("per_page", 2)})


def chunk_quality(chunks: DataFrame, child_target: int = 250, child_max: int = 384, parent_target: int = 1000, parent_max: int = 1200) -> DataFrame:
    """A document's chunk report from its chunks (document_id, chunk_id, parent_id, type, text, render, header, tokens, heading_only, has_code, mapped).

    Each failure costs 30 and each warning 7; shares of short or single
    children beyond their thresholds are warnings.
    """
    short_child = max(1, round(child_target * 0.48))
    short_parent = max(child_target, round(parent_target * 0.40))
    parent, child = F.col("type") == "PARENT", F.col("type") == "CHILD"
    blank = F.col("render").isNull() | (F.trim("render") == "")
    # a parent and its children are one group, in which only digests of texts are kept
    family = F.when(child, F.col("parent_id")).otherwise(F.col("chunk_id"))
    same = F.sha2(F.trim("text").cast("binary"), 256)
    single = (F.col("kids") == 1) & (F.col("parents") > 0)
    groups = chunks.withColumn("family", family).groupBy("document_id", "family").agg(
        F.count_if(parent).alias("parents"),
        F.count_if(child).alias("kids"),
        F.max(F.when(child, same)).alias("one_text"),
        F.collect_list(F.when(parent, same)).alias("own_texts"),
        F.count_if(~F.col("mapped")).alias("unmapped"),
        F.count_if(F.col("tokens") > F.when(parent, parent_max).otherwise(child_max)).alias("over_limit"),
        F.count_if(child & F.col("heading_only")).alias("heading_only"),
        F.count_if(blank).alias("empty_render"),
        F.count_if(F.col("header").rlike(r"\{#[\w:.-]+\}")).alias("anchors"),
        F.count_if(F.col("has_code") & ~F.col("render").contains("```") & ~F.col("render").contains("~~~")).alias("unfenced"),
        F.count_if(child & F.col("text").rlike(SUSPICIOUS_START)).alias("suspicious"),
        F.count_if(child & (F.col("tokens") < short_child)).alias("short_children"),
        F.count_if(parent & (F.col("tokens") < short_parent)).alias("short_parents"),
    )
    found = F.col("family").isNotNull() & (F.col("parents") > 0)
    out = groups.groupBy("document_id").agg(
        F.sum("parents").alias("parents"),
        F.sum("kids").alias("children"),
        F.sum(F.when(found, 0).otherwise(F.col("kids"))).alias("orphans"),
        F.sum(F.when(single & found, F.col("parents")).otherwise(0)).alias("one_child"),
        F.sum(F.when(single & found, F.size(F.filter("own_texts", lambda t: t == F.col("one_text")))).otherwise(0)).alias("identical"),
        *[F.sum(c).alias(c) for c in ("unmapped", "over_limit", "heading_only", "empty_render", "anchors", "unfenced", "suspicious", "short_children", "short_parents")],
    )
    order = ["document_id", "parents", "children", "unmapped", "over_limit", "orphans", "heading_only", "one_child", "identical", "empty_render", "anchors", "unfenced", "suspicious", "short_children", "short_parents"]
    out = out.select(order)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns({"short_child_ratio": ratio("short_children", "children"), "short_parent_ratio": ratio("short_parents", "parents"), "one_child_ratio": ratio("one_child", "parents")})
    c = F.col
    out = _report(out, [
        ("EMPTY_CHUNK_SET", "FAIL", 30, (c("parents") == 0) | (c("children") == 0)),
        ("UNMAPPED_CHUNKS", "FAIL", 30, c("unmapped") > 0),
        ("TOKEN_HARD_LIMIT_EXCEEDED", "FAIL", 30, c("over_limit") > 0),
        ("ORPHAN_CHILDREN", "FAIL", 30, c("orphans") > 0),
        ("EMPTY_RENDER_CONTENT", "FAIL", 30, c("empty_render") > 0),
        ("UNFENCED_CODE_RENDER", "FAIL", 30, c("unfenced") > 0),
        ("HEADING_ANCHOR_CONTAMINATION", "FAIL", 30, c("anchors") > 0),
        ("HEADING_ONLY_CHILDREN", "WARNING", 7, c("heading_only") > 0),
        ("IDENTICAL_SINGLE_CHILD_PARENTS", "WARNING", 7, c("identical") > 0),
        ("SUSPICIOUS_CHILD_START", "WARNING", 7, c("suspicious") > 0),
        ("EXCESS_SHORT_CHILDREN", "WARNING", 7, c("short_child_ratio") > 0.15),
        ("EXCESS_SHORT_PARENTS", "WARNING", 7, c("short_parent_ratio") > 0.25),
        ("EXCESS_SINGLE_CHILD_PARENTS", "WARNING", 7, c("one_child_ratio") > 0.25),
    ])
    return out.withColumns({x: F.round(x, 4) for x in ("short_child_ratio", "short_parent_ratio", "one_child_ratio")})
