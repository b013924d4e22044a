"""Blocks to parent and child chunks, with source maps and candidate spans.

A document's blocks are cut into units where they are too long, and a fold over
the document's units, inside Spark's own expressions, decides where a new chunk
starts. Everything else is grouping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import LEXICAL_SPECIAL, let, lexical_tokens, name_uuid, terms

#: Marks that end a sentence, marks that close one, and words and marks that carry a statement of code on (fixed values).
ENDS = "。！？!?；;"
CLOSES = r"，。；：、！？,.;:!?)}\]\"'”’）\p{Pe}\p{Pf}"
CONTINUES = r"(?i)^\s*(?:[)\]},;]|(?:AS\s+\$\$|(?:ELSE|ELIF|EXCEPT|FINALLY|CATCH|RETURN|YIELD|FROM|WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|ON|AND|OR|VALUES|SET|JOIN|LATERAL\s+VIEW|DISTRIBUTED\s+BY|PROPERTIES)\b))"
#: A sentence with what closes it, and a line with the blank ones after it: together they are the whole text.
SENTENCE = rf"\s*\S[^{ENDS}\n]*[{ENDS}\n]*[\s{CLOSES}]*"
LINE = r"\s*\S[^\n]*(?:\n+|$)(?:\s+$)?"
#: The same, with marks that no sentence begins as units of their own.
SENTENCE_OR_REST = "[^。！？!?；;\\n]+[。！？!?；;\\n]*[\"'”’）)]*|[。！？!?；;\\n]+[\"'”’）)]*"


@dataclass(frozen=True)
class Policy:
    parent_target: int = 1000
    parent_max: int = 1200
    parent_overlap: int = 100
    child_target: int = 250
    child_max: int = 384
    child_overlap: int = 40
    version: str = "parent-child-250-1000"

    def __post_init__(self):
        for target, most, overlap in ((self.parent_target, self.parent_max, self.parent_overlap), (self.child_target, self.child_max, self.child_overlap)):
            if not 0 <= overlap < target <= most:
                raise ValueError("a target is above its overlap and at most its limit")
        if self.parent_target < self.child_target:
            raise ValueError("parents are at least as long as children")


def units(blocks: DataFrame, limit: int) -> DataFrame:
    """Blocks (document_id, order_index, type, level, text, heading_path) cut into units of at most ``limit`` tokens: adds unit, start, unit_text, tokens, glued.

    Tables, code and lists are cut at lines, other blocks at sentences, and what
    is still too long between words (a longer word inside it). A block's units
    are its whole text; ``start`` is a unit's offset there. A ``glued`` unit is a
    line that carries on the one before it.
    """
    lines = F.col("type").isin("TABLE", "CODE", "LIST")
    natural = F.when(lines, F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))
    pieces = blocks.select(*blocks.columns, F.posexplode(natural).alias("s1", "piece"))
    parts = pieces.select(*blocks.columns, "s1", F.posexplode(cut_hard(F.col("piece"), limit)).alias("s2", "unit_text"))
    stretch = ["stretch"] if "stretch" in blocks.columns else []  # where a block's stretch was dealt to, its units stay
    w = Window.partitionBy("document_id", *stretch, "order_index").orderBy("s1", "s2")
    before = F.coalesce(F.sum(F.length("unit_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    glued = lines & (F.col("s2") == 0) & F.col("unit_text").rlike(rf"^\s*[{CLOSES}]") | ((F.col("type") == "CODE") & F.col("unit_text").rlike(CONTINUES))
    out = parts.withColumns({"unit": F.row_number().over(w) - 1, "start": before, "glued": glued & (F.col("s1") > 0)})
    return out.withColumn("tokens", F.greatest(F.lit(1), lexical_tokens(F.col("unit_text")))).drop("s1", "s2")


def cut_hard(s: Column, limit: int) -> Column:
    """A text in pieces of at most ``limit`` tokens: itself, or cut between words, or by as many characters where characters can be tokens of their own."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))
    run = rf"\s*+(?:(?:[\p{{L}}\p{{Nd}}_-]{{1,4}}+|[^\s\p{{L}}\p{{Nd}}_-])\s*+){{1,{limit}}}"
    words = F.regexp_extract_all(s, F.lit(rf"{run}(?<![\p{{L}}\p{{Nd}}_-](?=[\p{{L}}\p{{Nd}}_-]))|{run}"), F.lit(0))
    return F.when(lexical_tokens(s) <= limit, F.array(s)).when(s.rlike(LEXICAL_SPECIAL), pieces).otherwise(words)


def fold(rows: DataFrame, keys: list[str], order: list[str], target: int, most: int, *, overlap: int = 0, whole: int = 0, short: int = 0, heading: tuple[int, int] | None = None, with_all: bool = False) -> DataFrame:
    """Rows gathered into chunks by a fold over their tokens in order: keys, chunk (its number within ``keys``), own (its rows).

    A chunk ends when the next row would pass ``most`` or it has ``target``
    tokens, unless it ends with a heading or the next row is ``glued``; a block
    (``order[0]``) of at most ``whole`` tokens isn't torn. The next chunk begins
    with the last rows of the one before it, as many as ``overlap`` tokens hold,
    if there is room. With ``heading`` (tokens from which a section is long
    enough, tokens from which a chunk is nearly full) a chunk also ends, and
    nothing is repeated, before a first-level heading once there is content,
    before a second-level heading or another section (first two headings) when
    long enough, and before any heading when nearly full. A last chunk of fewer
    than ``short`` tokens joins the one before it where both fit. ``with_all``
    adds chunk -1 of all rows.
    """
    columns = set(rows.columns)
    inside, by_place = Window.partitionBy(*keys, order[0]), Window.partitionBy(*keys).orderBy(*order)
    total, last = F.sum("tokens").over(inside), F.lag(order[0]).over(by_place)
    begins = last.isNull() | (last != F.col(order[0]))
    head = F.coalesce(F.col("type").isin("TITLE", "HEADING"), F.lit(False))
    moved = F.lit(False)
    if heading and "heading_path" in columns:
        section = F.slice(F.coalesce("heading_path", F.array().cast("array<string>")), 1, 2)
        moved = F.coalesce(F.lag(section).over(by_place) != section, F.lit(False))
    rest = [c for c in rows.columns if c not in {*order, *keys}]
    marked = rows.withColumns({
        "cum_": F.coalesce(F.sum("tokens").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open_": begins | (total > whole), "need_": F.when(begins & (total <= whole), total).otherwise(F.col("tokens")),
        "head_": head, "begins_head_": head & begins, "moved_": moved & begins, "stays_": F.col("glued") if "glued" in columns else F.lit(False),
        "depth_": F.when(F.col("type") == "TITLE", 1).otherwise(F.coalesce("level", F.lit(9))),
    })
    near = Window.partitionBy(*keys).orderBy("cum_").rangeBetween(-overlap, -1)
    tail = {"tail_": F.count(F.lit(1)).over(near), "tail_tokens_": F.coalesce(F.col("cum_") - F.min("cum_").over(near), F.lit(0))} if overlap else {"tail_": F.lit(0).cast("long"), "tail_tokens_": F.lit(0).cast("long")}
    marked = marked.withColumns(tail)
    state = ["cum_", "open_", "need_", "head_", "begins_head_", "moved_", "stays_", "depth_", "tail_", "tail_tokens_"]
    gathered = marked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*rest).alias("row_"), *state))).alias("units"))
    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("first"), zero.alias("at"), zero.alias("base"))
    begin = F.struct(zero.alias("tokens"), F.lit(False).alias("content"), F.lit(False).alias("after_head"), zero.alias("i"), zero.alias("first"), F.array(first).alias("starts"))

    def step(s, u):
        meaning = F.lit(False)
        if heading:
            enough, full = heading
            meaning = (u["begins_head_"] & (((u["depth_"] == 1) & s["content"]) | ((u["depth_"] == 2) & (s["tokens"] >= enough)) | (s["tokens"] >= full))) | (u["moved_"] & (s["tokens"] >= enough))
        new = (s["tokens"] > 0) & u["open_"] & (meaning | (s["tokens"] + u["need_"] > most) | ((s["tokens"] >= target) & ~s["after_head"] & ~u["stays_"]))
        short_of = u["tail_"] > s["i"] - s["first"]
        tokens = F.when(short_of, s["tokens"]).otherwise(u["tail_tokens_"])
        repeats = ~meaning & (tokens + u["need_"] <= most)
        tail_tokens = F.when(repeats, tokens).otherwise(zero)
        start = s["i"] - F.when(repeats, F.least(u["tail_"], s["i"] - s["first"])).otherwise(zero)
        entry = F.struct(start.alias("first"), s["i"].alias("at"), (u["cum_"] - tail_tokens).alias("base"))
        return F.struct(
            (F.when(new, tail_tokens).otherwise(s["tokens"]) + u["row_"]["tokens"]).alias("tokens"),
            ((s["content"] & (~new | ((tail_tokens > 0) & ~s["after_head"]))) | ~u["head_"]).alias("content"), u["head_"].alias("after_head"),
            (s["i"] + 1).alias("i"), F.when(new, start).otherwise(s["first"]).alias("first"), F.when(new, F.concat(s["starts"], F.array(entry))).otherwise(s["starts"]).alias("starts"),
        )

    # the fold keeps a place for each chunk, not for each row; the rows are then cut at these places
    folded = gathered.withColumn("end_", F.aggregate("units", begin, step))
    n, starts = F.size("end_.starts"), F.col("end_.starts")
    last_row = F.element_at("units", -1)
    joined = last_row["cum_"] + last_row["row_"]["tokens"] - F.get(starts, n - 2)["base"]
    absorbs = (n > 1) & (F.col("end_.tokens") < short) & (joined <= most)
    folded = folded.withColumn("starts", F.when(absorbs, F.slice(starts, 1, n - 1)).otherwise(starts))
    end = lambda i: F.coalesce(F.get("starts", i + 1)["at"], F.size("units").cast("long"))
    chunks = F.transform("starts", lambda a, i: F.slice("units", (a["first"] + 1).cast("int"), (end(i) - a["first"]).cast("int")))
    if with_all:
        chunks = F.concat(F.array("units"), chunks)
    cut = folded.select(*keys, F.posexplode(chunks).alias("chunk", "own"))
    own = F.transform("own", lambda u: F.struct(*[u[c].alias(c) for c in order], *[u["row_"][c].alias(c) for c in rest]))
    return cut.select(*keys, (F.col("chunk") - int(with_all)).alias("chunk"), own.alias("own"))


def assign(rows: DataFrame, keys: list[str], order: list[str], target: int, most: int, **options) -> DataFrame:
    """Rows with ``chunk``, as ``fold`` gathers them; a repeated row is there for each of its chunks."""
    each = fold(rows, keys, order, target, most, **options).select(*keys, "chunk", F.explode("own").alias("u"))
    return each.select(*keys, *[F.col(f"u.{c}").alias(c) for c in rows.columns if c not in keys], "chunk")


def fence(code: Column) -> Column:
    """Ticks that can stand around ``code``: three, or one more than its longest run of them."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def chunk_columns(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows (document_id, parent_no, child_no, pieces) with their text, rendering, header, tokens, hash and stable id; child -1 is the parent."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = F.array_join(F.transform("pieces", lambda p: strip(p["unit_text"])), "\n\n")

    def rendered(p: Column) -> Column:
        own = strip(p["unit_text"])
        return (
            F.when(p["type"].isin("TITLE", "HEADING"), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.coalesce(p["level"], F.lit(1)))), F.lit(" "), own))
            .when(p["type"] == "CODE", let(fence(own), lambda f: F.concat(f, F.coalesce(p["language"], F.lit("")), F.lit("\n"), own, F.lit("\n"), f)))
            .otherwise(own)
        )

    header = F.array_join(F.coalesce(F.get(F.filter(F.transform("pieces", lambda p: p["heading_path"]), lambda h: F.size(h) > 0), F.lit(0)), F.array().cast("array<string>")), " > ")
    kind = F.when(F.col("child_no") < 0, "PARENT").otherwise("CHILD")
    out = rows.withColumns({"type": kind, "text": text, "render": F.array_join(F.transform("pieces", rendered), "\n\n"), "header": header})
    out = out.withColumn("order_index", F.row_number().over(Window.partitionBy("document_id", "type").orderBy("parent_no", "child_no")) - 1)
    out = out.withColumns({"tokens": lexical_tokens(F.col("text")), "hash": F.sha2(F.concat_ws("\0", "header", "text", "render").cast("binary"), 256)})
    out = out.withColumn("chunk_id", name_uuid(F.concat_ws(":", F.col("document_id").cast("string"), F.lower("type"), F.col("order_index").cast("string"), "hash")))
    parent = F.first("chunk_id").over(Window.partitionBy("document_id", "parent_no").orderBy("child_no"))
    out = out.withColumn("parent_id", F.when(F.col("type") == "CHILD", parent))
    embedding = F.when(F.trim("header") == "", F.col("render")).otherwise(F.concat(F.lit("Section: "), F.col("header"), F.lit("\n\n"), F.col("render")))
    return out.select("document_id", "parent_no", "chunk_id", "parent_id", "type", "order_index", "text", "render", "header", embedding.alias("embedding_text"), "tokens", "hash", F.lit(policy.version).alias("policy"), "pieces")


def stretches(blocks: DataFrame) -> DataFrame:
    """``blocks`` with stretch: how many first-level headings (or titles) that follow on a block of another kind stand up to it.

    Before such a heading a parent ends in any case and nothing is repeated, so the fold
    of what follows doesn't depend on what came before: stretches are folded apart, in tasks of their own.
    """
    head = F.coalesce(F.col("type").isin("TITLE", "HEADING"), F.lit(False))
    first = (F.col("type") == "TITLE") | ((F.col("type") == "HEADING") & (F.coalesce("level", F.lit(9)) == 1))
    by_place = Window.partitionBy("document_id").orderBy("order_index")
    begins = F.coalesce(first & ~F.lag(head).over(by_place), F.lit(False))
    marked = blocks.withColumn("begins", begins.cast("long"))
    return marked.withColumn("stretch", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def parent_child(blocks: DataFrame, policy: Policy = Policy(), split: bool = True, deal: bool = True) -> DataFrame:
    """Parents and children of documents' blocks; a child names its parent. Blank blocks, page headers and footers are left out.

    With ``split``, a document's :func:`stretches` are folded apart, and with ``deal`` in different tasks, with the same result.
    Documents that are small to a task needn't be dealt: blocks that lie by document then move no more.
    """
    own = blocks.where((F.trim("text") != "") & ~F.col("type").isin("PAGE_HEADER", "PAGE_FOOTER"))
    for c, t in (("level", "int"), ("heading_path", "array<string>"), ("language", "string")):
        if c not in own.columns:
            own = own.withColumn(c, F.array().cast(t) if c == "heading_path" else F.lit(None).cast(t))
    own = own.select("document_id", "order_index", "type", "level", "text", "heading_path", "language")
    own = own.withColumn("level", F.when(F.col("type") == "HEADING", F.coalesce("level", F.size("heading_path"))).otherwise(F.col("level")))
    own = stretches(own) if split else own.withColumn("stretch", F.lit(0).cast("long"))
    own = own.repartition("document_id", "stretch") if split and deal else own
    least = min(policy.parent_target, max(2 * policy.child_target, round(0.6 * policy.parent_target)))
    place = ["order_index", "unit"]
    parts = assign(
        units(own, policy.child_max).drop("text"), ["document_id", "stretch"], place, policy.parent_target, policy.parent_max, overlap=policy.parent_overlap,
        whole=max(policy.parent_target, policy.parent_max - policy.parent_overlap), heading=(least, policy.parent_max - policy.child_target),
    ).withColumnRenamed("chunk", "parent_no")
    # a parent and its children come from one row
    kids = fold(
        parts, ["document_id", "stretch", "parent_no"], place, policy.child_target, policy.child_max, overlap=policy.child_overlap,
        whole=policy.child_max, short=max(1, round(0.48 * policy.child_target)), with_all=True,
    ).withColumnRenamed("chunk", "child_no")

    # a block's units are one piece again: they lie side by side in its text
    def piece(units_: Column) -> Column:
        first = F.get(units_, F.lit(0))
        text = F.array_join(F.transform(units_, lambda u: u["unit_text"]), "")
        return F.struct(*[first[c].alias(c) for c in ("order_index", "unit", "start", "type", "level")], text.alias("unit_text"), first["heading_path"].alias("heading_path"), first["language"].alias("language"))

    blocks_ = F.array_distinct(F.transform("own", lambda u: u["order_index"]))
    pieces = F.transform(blocks_, lambda b: let(F.filter("own", lambda u: u["order_index"] == b), piece))
    number = F.dense_rank().over(Window.partitionBy("document_id").orderBy("stretch", "parent_no")) - 1
    return chunk_columns(kids.select("document_id", number.alias("parent_no"), "child_no", pieces.alias("pieces")), policy)


def source_map(chunks: DataFrame) -> DataFrame:
    """Where each piece of a chunk's text comes from: chunk_id, ord, chunk_start, chunk_end, order_index, unit, block_start, block_end; the two line ends between pieces map to nothing."""
    each = chunks.select("chunk_id", F.posexplode("pieces").alias("ord", "p"))
    each = each.withColumns({"n": F.length(F.regexp_replace("p.unit_text", r"^\s+|\s+$", "")), "lead": F.length("p.unit_text") - F.length(F.regexp_replace("p.unit_text", r"^\s+", ""))})
    before = F.coalesce(F.sum(F.col("n") + 2).over(Window.partitionBy("chunk_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("p.start") + F.col("lead")
    return each.select("chunk_id", "ord", before.alias("chunk_start"), (before + F.col("n")).alias("chunk_end"), "p.order_index", "p.unit", start.alias("block_start"), (start + F.col("n")).alias("block_end"))


def candidate_spans(parents: DataFrame, queries: DataFrame, limit: int = 600, most: int = 16) -> DataFrame:
    """Each query's spans in its parents, at most ``most`` a parent: query_id, parent_id, span, span_id, relevance, tokens.

    ``queries``: query_id, parent_id, focus, anchor (the matched child's text).
    Spans are runs of sentences of at most ``limit`` tokens (a longer sentence
    is cut), and cover the parent whole; the order is the distance to the
    anchor, then how often the focus terms occur, then place.
    """
    own = parents.select("document_id", F.col("chunk_id").alias("parent_id"), "text", F.lit(0).alias("order_index"), F.lit("PARAGRAPH").alias("type"), F.lit(None).cast("int").alias("level"))
    # every character is in a unit: sentences, and what is too long cut at the limit, with their places
    cut = F.regexp_extract_all("text", F.lit(SENTENCE_OR_REST), F.lit(0))
    pieces = own.select("parent_id", "order_index", "type", "level", F.posexplode(F.flatten(F.transform(cut, lambda s: cut_hard(s, limit)))).alias("unit", "unit_text"))
    w = Window.partitionBy("parent_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"tokens": lexical_tokens(F.col("unit_text")), "at": F.coalesce(F.sum(F.length("unit_text")).over(w), F.lit(0))})
    spans = assign(pieces, ["parent_id"], ["order_index", "unit"], limit, limit)
    spans = spans.groupBy("parent_id", F.col("chunk").alias("span")).agg(F.min("at").alias("start"), F.max(F.col("at") + F.length("unit_text")).alias("end"), F.sum("tokens").alias("tokens"))
    wholes = parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("whole"))
    spans = spans.join(wholes, "parent_id").withColumn("span_text", F.expr("substring(whole, start + 1, end - start)"))
    met = spans.join(queries, "parent_id")
    at = F.expr("locate(anchor, whole) - 1")
    away = F.when(at < 0, F.lit(2**31 - 1)).otherwise(F.greatest(F.lit(0), F.col("start") - at - F.length("anchor"), at - F.col("end")))
    count = F.aggregate(terms(F.col("focus")), F.lit(0), lambda n, t: n + F.size(F.split(F.lower("span_text"), F.concat(F.lit("\\Q"), t, F.lit("\\E")))) - 1)
    met = met.withColumns({"away": away, "relevance": count})
    met = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("away", F.desc("relevance"), "start"))).where(F.col("n") <= most)
    span_id = F.sha2(F.concat_ws("\x1f", "parent_id", F.col("start").cast("string"), F.col("end").cast("string"), F.sha2(F.col("whole").cast("binary"), 256)).cast("binary"), 256)
    return met.select("query_id", "parent_id", "span", span_id.alias("span_id"), "relevance", "tokens", F.col("n").alias("place"), "start", "end")
