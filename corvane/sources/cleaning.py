"""Markdown cleaning as Column expressions: a text is read once as a row of segments, and each kind of segment has its rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of segments, in the order in which they are tried at each place; the last two take what is left.
SEGMENTS = {
    "fence": r"```.*?(?:```|\z)",
    "code": r"`[^`\n]+`",
    "comment": r"<!--.*?(?:-->|\z)",
    "element": r"<(?i:(script|style|nav|template))\b.*?</\1\s*>",
    "tag": r"</?[A-Za-z][^<>]*>",
    "link": r"!?\[[^\]\n]*\]\([^)\n]*\)",
    "shortcode": r"\{\{.*?\}\}",
    "prose": r"[^`<!\[{]+",
    "mark": r".",
}
SEGMENT = "(?s)" + "|".join(SEGMENTS.values())
#: Whole lines of prose that say nothing: module lines and places for a table of contents.
EMPTY_LINES = r"(?<=\n)[ \t]*(?:(?:import|export)[ \t][^\n]*|(?i:\[toc\]|table of contents|目录)[ \t]*)(?=\n)"
FRONT_MATTER = r"(?s)\A---\n.*?\n---\n"


def clean_markdown(text: Column) -> Column:
    """The text without front matter, comments, markup and link targets; fenced and inline code stays as it is.

    Of links and pictures their words stay, of a line-break tag a line end, of
    other tags nothing; scripts, styles, navigation and templates go with what
    they hold. Null stays null, and an empty text empty.
    """
    body = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), FRONT_MATTER, "")

    def kept(s: Column) -> Column:
        return (
            F.when(s.startswith("`"), s)
            .when(s.rlike(r"(?i)\A<br\s*/?>\z"), F.lit("\n"))
            .when(s.rlike(r"\A(?:<!--|</?[A-Za-z]|\{\{)(?s:.+)\z"), F.lit(""))
            .when(s.rlike(r"\A!?\[[^\]]*\]\("), F.regexp_extract(s, r"\A!?\[([^\]]*)\]", 1))
            .otherwise(F.regexp_replace(s, EMPTY_LINES, ""))
        )

    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(SEGMENT), F.lit(0)), kept), "")
