"""Documents to blocks: format detection, Markdown, HTML and plain text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A list line, a heading line and a table's separator line (fixed values).
LIST_LINE = r"^\s*(?:[-+*•]|\d+[.)])\s+"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
SEPARATOR = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?$"
ANCHOR = r"\s*\{#([\w:.-]+)\}\s*$"


def detect_format(head: Column, name: Column, content_type: Column) -> Column:
    """pdf, docx, xlsx, markdown, html or text by first bytes, then media type, then extension; null if unknown.

    ``head`` is the content's start as a string; an archive's kind shows in its
    member names there.
    """
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    office = "application/vnd.openxmlformats-officedocument."
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("PK") & head.contains("word/"), "docx")
        .when(head.startswith("PK") & head.contains("xl/"), "xlsx")
        .when((kind == "application/pdf") | (ext == ".pdf"), "pdf")
        .when((kind == office + "wordprocessingml.document") | (ext == ".docx"), "docx")
        .when((kind == office + "spreadsheetml.sheet") | (ext == ".xlsx"), "xlsx")
        .when(kind.isin("text/markdown", "text/x-markdown") | ext.isin(".md", ".markdown"), "markdown")
        .when(kind.isin("text/html", "application/xhtml+xml") | ext.isin(".html", ".htm"), "html")
        .when(kind.startswith("text/") | ext.isin(".txt", ".text"), "text")
    )


def verify_content(files: DataFrame) -> DataFrame:
    """Files (content, declared_hash) with their SHA-256 and whether it is the declared one; a null or all-zero one is unknown and passes."""
    own = F.sha2("content", 256)
    unknown = F.col("declared_hash").isNull() | (F.col("declared_hash") == "0" * 64)
    return files.withColumn("sha256", own).withColumn("verified", unknown | (F.lower("declared_hash") == own))


def clean_lines(text: Column) -> Column:
    """Blanks in each line as one space, lines trimmed, blank lines at both ends gone."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def text_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain texts (document_id, text), split at blank lines: document_id, order_index, type, text, page."""
    plain = F.regexp_replace("text", "\r\n?", "\n")
    parts = docs.select("document_id", F.posexplode(F.split(plain, r"\n[ \t]*\n+")).alias("at", "text"))
    parts = parts.withColumn("text", clean_lines(F.col("text"))).where(F.col("text") != "")
    return parts.select("document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("at")) - 1).alias("order_index"), F.lit("PARAGRAPH").alias("type"), "text", F.lit(None).cast("int").alias("page"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown texts: document_id, order_index, type, level, text, heading_path, language, line_start, line_end.

    Lines are told apart by windows over their document: running counts of
    fences mark code, runs of lines with bars below a separator are tables, and
    runs of other lines are paragraphs or lists. A block's heading path holds,
    for each level, the last heading that no higher one followed.
    """
    whole = docs.select("document_id", "text").repartition("document_id")  # the only move: texts, not lines or blocks
    lines = whole.select("document_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("at", "line"))
    along = Window.partitionBy("document_id").orderBy("at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    x = lines.withColumn("bare", bare).withColumn("fence", F.col("bare").startswith("```"))
    x = x.withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    x = x.withColumn("code", F.col("fence") | (F.col("fences") % 2 == 1))
    x = x.withColumn("heading", ~F.col("code") & F.col("bare").rlike(HEADING))
    x = x.withColumn("bar", ~F.col("code") & ~F.col("heading") & F.col("bare").contains("|"))
    x = x.withColumn("run", F.sum(F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(along), F.lit(False)), 1).otherwise(0)).over(upto))
    opens = F.col("bar") & F.coalesce(F.lead("bar").over(along) & F.lead("bare").over(along).rlike(SEPARATOR), F.lit(False))
    x = x.withColumn("opens", opens)
    first = F.min(F.when(F.col("opens"), F.col("at"))).over(Window.partitionBy("document_id", "run", "bar"))
    x = x.withColumn("table", F.col("bar") & F.coalesce(F.col("at") >= first, F.lit(False)))
    kind = F.when(F.col("heading"), "HEADING").when(F.col("code"), "CODE").when(F.col("table"), "TABLE").when(F.col("bare") == "", "BLANK").otherwise("TEXT")
    x = x.withColumn("kind", kind)
    group = F.when(F.col("code"), F.floor((F.col("fences") + F.when(F.col("fence") & (F.col("fences") % 2 == 0), 0).otherwise(1)) / 2)).when(F.col("table"), F.col("run")).otherwise(0)
    x = x.withColumn("group", group)
    starts = F.col("heading") | F.coalesce((F.lag("kind").over(along) != F.col("kind")) | (F.lag("group").over(along) != F.col("group")), F.lit(True))
    x = x.withColumn("block", F.sum(starts.cast("int")).over(upto)).where(F.col("kind") != "BLANK")
    body = F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("at", "line"))))
    b = x.groupBy("document_id", "block", "kind").agg(
        F.array_join(F.transform(body, lambda r: F.when(F.col("kind") == "TABLE", F.trim(r["line"])).otherwise(F.regexp_replace(r["line"], r"[ \t\f\x0B]+$", ""))), "\n").alias("text"),
        F.min(F.when(F.col("fence"), F.struct("at", F.regexp_replace("bare", r"^`+\s*", "").alias("l"))))["l"].alias("language"),
        F.bool_and(F.col("line").rlike(LIST_LINE)).alias("all_list"),
        (F.min("at") + 1).alias("line_start"),
        (F.max("at") + 1).alias("line_end"),
    )
    b = b.withColumn("level", F.when(F.col("kind") == "HEADING", F.length(F.regexp_extract(F.trim("text"), HEADING, 1))))
    inline = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim("text"), HEADING, 2), ANCHOR, ""), r"\s+", " "))
    b = b.withColumn("text", F.when(F.col("kind") == "HEADING", inline).when(F.col("kind") == "CODE", F.regexp_replace("text", r"^\n+|\n+$", "")).otherwise(F.col("text"))).where(F.col("text") != "")
    seen = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    levels = {f"h{n}": F.last(F.when(F.col("level") == n, F.struct("block", "text")), ignorenulls=True).over(seen) for n in range(1, 7)}
    b = b.withColumns(levels)
    above = {n: F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{m}.block"), F.lit(-1)) for m in range(1, n)]) for n in range(1, 7)}
    path = F.array_compact(F.array(*[F.when(F.col(f"h{n}.block") > above[n], F.col(f"h{n}.text")) for n in range(1, 7)]))
    title = F.first(F.when(F.col("level") == 1, F.col("block")), ignorenulls=True).over(Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.when((F.col("kind") == "HEADING") & (F.col("block") == title), "TITLE").when((F.col("kind") == "TEXT") & F.col("all_list"), "LIST").when(F.col("kind") == "TEXT", "PARAGRAPH").otherwise(F.col("kind"))
    b = b.withColumns({"heading_path": path, "type": kind})
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("block")) - 1
    return b.select("document_id", order.alias("order_index"), "type", "level", "text", "heading_path", F.when((F.col("kind") == "CODE") & (F.col("language") != ""), F.col("language")).alias("language"), "line_start", "line_end")


#: Elements that hold no content, and those that are blocks (fixed values).
DROPPED = {"script", "style", "noscript", "template", "nav"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "table", "figcaption"}
#: Elements that end an open paragraph, and those without an end.
ENDS_P = BLOCKS | {"div", "ul", "ol", "article", "section", "header", "footer", "blockquote", "figure", "hr", "aside", "main"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects (tag, text) of a page's blocks in their order; blocks inside tables, code or list items aren't apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.at: list[tuple[str, list[str]]] = []
        self.out: list[list] = []
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        if "p" in self.open and tag in ENDS_P and "table" not in self.open:
            self.close("p")
        if tag in {"td", "th", "tr"} and self.at and self.at[-1][0] == "table":
            self.at[-1][1].append("\n" if tag == "tr" else "\t")
        if tag == "img" and (alt := dict(attrs).get("alt")) and not self.hidden() and not {"table", "pre"} & set(self.open):
            self.out.append(["img", [alt]])
        if tag in VOID:
            return
        self.open.append(tag)
        inside = {t for t, _ in self.at}
        if tag in BLOCKS and not self.hidden() and not ({"table", "pre"} & inside or tag == "p" and "li" in inside):
            parts: list[str] = []
            self.at.append((tag, parts))
            self.out.append([tag, parts])

    def handle_endtag(self, tag):
        if tag in self.open:
            self.close(tag)

    def close(self, tag):
        while self.open:
            last = self.open.pop()
            if self.at and self.at[-1][0] == last:
                self.at.pop()
            if last == tag:
                break

    def hidden(self) -> bool:
        return bool(DROPPED & set(self.open))

    def handle_data(self, data):
        if "title" in self.open:
            self.title.append(data)
        elif self.at and not self.hidden():
            self.at[-1][1].append(data)


def _table(parts: list[str]) -> str:
    rows = [[" ".join(c.split()).replace("\\", "\\\\").replace("|", "\\|") for c in r.split("\t")[1:]] for r in "".join(parts).split("\n")]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]])


def page_blocks(html: str) -> list[tuple[str, int | None, str]]:
    """(type, heading level, text) of a page's blocks; a page whose title no heading repeats begins with it."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close("html")
    out = []
    title = " ".join("".join(parser.title).split())
    for tag, parts in parser.out:
        text = _table(parts) if tag == "table" else "".join(parts).strip("\n") if tag == "pre" else " ".join("".join(parts).split())
        if not text:
            continue
        level = int(tag[1]) if tag[0] == "h" else None
        first = level == 1 and text == (title or text) and not any(t == "TITLE" for t, _, _ in out)
        kind = "TITLE" if first else "HEADING" if level else {"table": "TABLE", "pre": "CODE", "li": "LIST", "img": "CAPTION", "figcaption": "CAPTION"}.get(tag, "PARAGRAPH")
        out.append((kind, level, text))
    if not any(t == "TITLE" for t, _, _ in out):
        out.insert(0, ("TITLE", 1, title or "document"))
    return out


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages (document_id, text): document_id, order_index, type, level, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *b) for d, t in zip(pdf["document_id"], pdf["text"], strict=True) for i, b in enumerate(page_blocks(t))]
            yield pd.DataFrame(rows, columns=["document_id", "order_index", "type", "level", "text"]).astype({"level": "Int32"})

    return pages.select("document_id", "text").mapInPandas(run, "document_id long, order_index int, type string, level int, text string")


def sheet_regions(cells: DataFrame) -> DataFrame:
    """Runs of non-blank rows of sheets (sheet, row, col, value) as Markdown tables: sheet, region, first_row, last_row, text.

    Rows without a value part the regions; columns that are blank at both ends
    of a region are trimmed.
    """
    filled = cells.where(F.trim("value") != "")
    rows = filled.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("n"))
    region = F.col("row") - F.row_number().over(Window.partitionBy("sheet").orderBy("row"))
    rows = rows.withColumn("region", region)
    spread = filled.join(rows.select("sheet", "row", "region"), ["sheet", "row"])
    box = spread.groupBy("sheet", "region").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    line = spread.join(box, ["sheet", "region"]).groupBy("sheet", "region", "row", "c0", "c1").agg(F.map_from_entries(F.collect_list(F.struct("col", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")))).alias("m"))
    shown = F.transform(F.sequence("c0", "c1"), lambda c: F.replace(F.coalesce(F.try_element_at("m", c), F.lit("")), F.lit("|"), F.lit("\\|")))
    line = line.withColumn("text", F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |")))
    body = F.array_sort(F.collect_list(F.struct("row", "text")))
    out = line.groupBy("sheet", "region").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.transform(body, lambda r: r["text"]).alias("lines"), F.max(F.col("c1") - F.col("c0") + 1).cast("int").alias("width"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    text = F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", F.lit(2), F.size("lines"))), "\n")
    return out.select("sheet", (F.row_number().over(Window.partitionBy("sheet").orderBy("first_row"))).alias("region"), "first_row", "last_row", text.alias("text"))


def repeated_margins(lines: DataFrame) -> DataFrame:
    """Lines in page margins (document_id, page, text) that are headers or footers: on at least two pages and half of all."""
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    on = lines.withColumn("norm", norm).groupBy("document_id", "norm").agg(F.count_distinct("page").alias("on_pages"))
    return on.join(pages, "document_id").where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2))).select("document_id", "norm", "on_pages")
