"""Text measures as Column expressions: token estimates, character n-grams, overlaps, citation marks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Token classes of the lexical estimator (fixed values): one ideograph or syllable, a run of letters and digits, any other character.
LEXICAL_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{N}_-]+|[^\s]"
#: Ranges outside of which a text has no ideographs, syllables or numerals other than decimal digits.
LEXICAL_SPECIAL, WIDE_SPECIAL = r"[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\x{10ffff}]", r"[\u1100-\x{10ffff}]"
#: Phrases by which an answer says that it can't answer (fixed values).
ABSTENTIONS = [
    "证据不足", "资料不足", "现有资料未提供", "知识库没有提供", "知识库未提供", "无法判断", "无法确定", "无法确认", "无法根据",
    "无法给出可靠答案", "不能确定", "insufficient evidence", "not provided in the knowledge", "cannot determine", "unable to determine", "cannot confirm",
]


def canonical_space(text: Column) -> Column:
    """Trimmed, with each run of ASCII white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lexical_tokens(text: Column) -> Column:
    """Estimated tokens: a lexical run counts a quarter of its characters, rounded up, anything else one; null and blank count 0."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(LEXICAL_TOKEN), F.lit(0))
    weight = lambda t: F.when(t.rlike(r"^[\p{L}\p{Nd}_-]+$"), F.floor((F.length(t) + 3) / 4)).otherwise(F.lit(1).cast("long"))
    every = F.aggregate(found, F.lit(0).cast("long"), lambda n, t: n + weight(t))
    # without them a run is as many tokens as it has pieces of four characters
    plain = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}_-]{1,4}|[^\s]")).cast("long")
    return F.when(text.rlike(LEXICAL_SPECIAL), every).otherwise(plain)


def packing_tokens(text: Column) -> Column:
    """Estimated tokens for context packing: characters from U+3400 to U+9FFF count one, four others one, at least 1."""
    wide = F.regexp_count(text, F.lit("[㐀-鿿]"))
    return F.greatest(F.lit(1), wide + F.floor((F.length(text) - wide + 3) / 4)).cast("long")


def script_tokens(text: Column) -> Column:
    """Estimated tokens for model budgets: Han, kana and hangul count one, four others one; blank and null 1."""
    wide = F.when(text.rlike(WIDE_SPECIAL), F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))).otherwise(0)
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1), wide + F.floor((F.length(text) - wide + 3) / 4)).cast("long"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairs_of(normal: Column) -> Column:
    """Distinct two-character substrings; of one character, that character."""

    def pairs(s: Column) -> Column:
        n = F.length(s)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
        return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(s)).otherwise(F.array_distinct(many))

    return let(normal, pairs)


def grams(text: Column) -> Column:
    """Character pairs of the lower-case letters and digits."""
    return pairs_of(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""))


def coverage(expected: Column, actual: Column) -> Column:
    """The share of the expected text's character pairs that the actual text has; 0 for a blank expectation."""
    want, have = grams(F.coalesce(expected, F.lit(""))), grams(F.coalesce(actual, F.lit("")))
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(want, have)) / F.size(want))


def comparison_text(text: Column) -> Column:
    """Lower case without punctuation, symbols and white space."""
    return F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\s]", "")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with HTML's character references resolved."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def document_key(text: Column) -> Column:
    """What texts are compared by: references resolved, without ordinals such as "3." and "4)", digits, Latin letters and ideographs only, in lower case."""
    plain = F.regexp_replace(unescaped(text), r"(?U)(?<!\w)\d+[.)](?=\s)", "")
    return F.lower(F.regexp_replace(plain, "[^0-9a-zA-Z\u3400-\u4dbf\u4e00-\u9fff]+", ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def term_overlap(query: Column, text: Column) -> Column:
    """The share of the query's terms that the text has."""
    q = terms(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms(text))) / F.size(q))


def abstains(answer: Column) -> Column:
    """Whether an answer says that the evidence doesn't suffice."""
    normal = F.regexp_replace(F.lower(answer), r"\s+", " ")
    hits = [normal.contains(p) for p in ABSTENTIONS]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return F.coalesce(found, F.lit(False))


def citations(answer: Column) -> Column:
    """Distinct marks of the form [E1], in order, as E1."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(E\d+)\]"), F.lit(1)), lambda x: x))


def document_references(text: Column) -> Column:
    return F.regexp_count(text, F.lit("《[^》]*》"))


def ideographs(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def name_uuid(value: Column) -> Column:
    """The name-based (MD5) UUID of a string's UTF-8 bytes."""
    h = F.md5(value.cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def merge_sources(a: Column, b: Column) -> Column:
    """An ordered list without repeats of both lists' entries."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
