"""Evaluation data sets: evidence of documents, cases made from it, harder cases made from those, and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import document_key

#: Ideographs, marks that end a sentence, and how a picture's caption begins (fixed values).
IDEOGRAPH = "[\u3400-\u4dbf\u4e00-\u9fff]"
SENTENCE_MARKS = "。！？；"
CAPTION = "图片说明："
SPACE = r"(?U)\s+"
#: The share of cases by category, and what a case of each asks; {title}, {heading} and, with two documents, {other}, {other_heading} are filled in.
QUESTIONS = {
    "direct_fact": "What does {title} state in its part {heading}?",
    "procedure_condition": "Which steps or conditions does {title} give under {heading}?",
    "cross_document": "Summarize what {title} says under {heading} and what {other} says under {other_heading}.",
}
#: What the harder cases ask of one to three topics; how far apart their documents stand, and the places where they begin.
CHALLENGES = {
    "multi_intent": ([0, 23], range(0, 20), "Two separate goals came up: {0}; {1}. Find the conditions, steps and limits of each."),
    "query_decomposition": ([0, 17, 34], range(0, 15), "Plan three phases: first {0}; second {1}; third {2}. Which rules does each rest on?"),
    "semantic_paraphrase": ([0], range(30, 40), "Nobody recalls the document, only that it is about {0}. What are its conditions and limits?"),
    "keyword_sparse": ([0], range(45, 50), "A ticket says only: {0}. Which requirements apply?"),
}


def ideographs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(IDEOGRAPH))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def evidence_blocks(documents: DataFrame, least: int = 35, most: int = 220, heading: str = "Document") -> DataFrame:
    """Quotable blocks of Markdown: document_id, n (the block's place), heading, quote.

    ``documents``: document_id, text. Blocks stand between blank lines. Code,
    tables, captions and blocks of fewer than ``least`` ideographs are left
    out; a block is cut after its first sentence that holds ``least`` of them, if
    that ends within ``most`` + 1 characters, or else at the last space before
    ``most``, and stands under the last heading before it. Of blocks of
    a document with one key the first stays. Null texts have none.
    """
    text = F.col("block")
    b = documents.where(F.col("text").isNotNull()).select("document_id", F.posexplode(F.split("text", r"\n(?U:\s*)\n")).alias("n", "block"))
    b = b.withColumn("block", F.regexp_replace("block", r"(?U)^\s+|\s+$", "")).where("block <> ''")
    before = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    fence = text.startswith("```")
    b = b.withColumn("in_code", F.coalesce(F.last(F.when(fence, F.regexp_count(text, F.lit("```")) % 2 == 1), ignorenulls=True).over(before), F.lit(False)))
    b = b.where(~fence & ~F.col("in_code")).withColumn("title", F.when(text.rlike(r"^#{1,6}(?U:\s+).+$"), normal_space(F.regexp_replace(F.regexp_extract(text, r"^#{1,6}(?U:\s+)(.+)$", 1), "[`*_]", ""))))
    b = b.withColumn("heading", F.coalesce(F.last("title", ignorenulls=True).over(before), F.lit(heading)))
    plain = F.col("title").isNull() & ~text.startswith("|") & (F.regexp_count(text, F.lit(r"\|")) <= 8) & ~text.startswith(CAPTION) & (ideographs(text) >= least)
    b = b.where(plain).withColumn("line", normal_space(text))
    start = F.substring("line", 1, most + 1)
    sentence = F.regexp_extract(start, f"^(?:[^{IDEOGRAPH[1:-1]}]*{IDEOGRAPH}){{{least}}}[^{SENTENCE_MARKS}]*[{SENTENCE_MARKS}]", 0)
    words = F.regexp_extract(start, f"^(.{{{min(120, most)},{most}}}) ", 1)
    quote = F.when(sentence != "", sentence).when(F.length("line") > most, F.when(words != "", words).otherwise(F.substring("line", 1, most))).otherwise(F.col("line"))
    b = b.withColumn("quote", quote).where(ideographs(F.col("quote")) >= least)
    b = b.withColumn("key", F.sha2(document_key(F.col("quote")), 256))
    first = Window.partitionBy("document_id", "key").orderBy("n")
    return b.withColumn("again", F.row_number().over(first)).where("again = 1").select("document_id", "n", "heading", "quote")


def expected_answer(quote: Column) -> Column:
    """A quote without its list mark, emphasis and runs of spaces."""
    return normal_space(F.regexp_replace(F.regexp_replace(quote, r"^\s*(?:[-+*]|\d+[.)])\s+", ""), "[`*_]", ""))


def _filled(template: str, **values: Column) -> Column:
    """A template with columns in place of its names."""
    return reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def synthesize_cases(documents: DataFrame, evidence: DataFrame, pairs: int = 6, questions: dict[str, str] = QUESTIONS) -> DataFrame:
    """Cases with an answer: category, source, document_ids, headings, quotes, question, expected_answer, mode.

    ``documents``: document_id, source, title; ``evidence`` as ``evidence_blocks``
    returns it. Each document of two blocks or more gives a direct question on
    its first and a question on the steps in its second; of each
    source, the first ``2 * pairs`` such documents by id make ``pairs`` questions on
    two of them. Only those are numbered, so a large source is cut to
    them before it moves.
    """
    place = Window.partitionBy("document_id").orderBy("n")
    two = evidence.withColumn("r", F.row_number().over(place)).where("r <= 2")
    two = two.groupBy("document_id").agg(F.max(F.when(F.col("r") == 1, F.struct("heading", "quote"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("heading", "quote"))).alias("b"))
    d = documents.select("document_id", "source", "title").join(two.where(F.col("b").isNotNull()), "document_id")

    def single(category: str, block: str) -> Column:
        e = F.col(block)
        return F.struct(F.lit(category).alias("category"), F.array(e.heading).alias("headings"), F.array(e.quote).alias("quotes"),
                        _filled(questions[category], title=F.col("title"), heading=e.heading).alias("question"), expected_answer(e.quote).alias("expected_answer"), F.lit("FAST").alias("mode"))

    ones = d.select("source", F.array("document_id").alias("document_ids"), F.explode(F.array(single("direct_fact", "a"), single("procedure_condition", "b"))).alias("c")).select("source", "document_ids", "c.*")
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("document_id"))).where(F.col("r") <= 2 * pairs)
    two_by_two = first.groupBy("source", F.expr("(r - 1) div 2").alias("pair")).agg(F.array_sort(F.collect_list(F.struct("r", "document_id", "title", "a"))).alias("p")).where(F.size("p") == 2)
    x, y = F.col("p")[0], F.col("p")[1]
    answer = F.concat(x.title, F.lit(": "), expected_answer(x.a.quote), F.lit(" "), y.title, F.lit(": "), expected_answer(y.a.quote))
    question = _filled(questions["cross_document"], title=x.title, heading=x.a.heading, other=y.title, other_heading=y.a.heading)
    both = two_by_two.select("source", F.array(x.document_id, y.document_id).alias("document_ids"), F.lit("cross_document").alias("category"), F.array(x.a.heading, y.a.heading).alias("headings"),
                             F.array(x.a.quote, y.a.quote).alias("quotes"), question.alias("question"), answer.alias("expected_answer"), F.lit("DEEP").alias("mode"))
    return ones.unionByName(both)


def synthesize_challenges(topics: DataFrame, ring: int = 50, challenges: dict = CHALLENGES) -> DataFrame:
    """Harder cases: challenge, source, place, document_ids, question.

    ``topics``: source, document_id, topic. The first ``ring`` of a source by id
    stand in a ring; a challenge that begins at a place takes the topics at
    its steps from there. Sources with fewer have none.
    """
    t = topics.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("document_id")) - 1).where(F.col("place") < ring)
    rings = t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "document_id", "topic"))).alias("ring")).where(F.size("ring") == ring)
    at = lambda i: F.col("ring")[(F.col("place") + i) % ring]
    out = []
    for name, (steps, places, template) in challenges.items():
        each = rings.select("source", "ring", F.explode(F.array(*[F.lit(p) for p in places])).alias("place"))
        question = _filled(template, **{str(k): at(i).topic for k, i in enumerate(steps)})
        out.append(each.select(F.lit(name).alias("challenge"), "source", "place", F.array(*[at(i).document_id for i in steps]).alias("document_ids"), question.alias("question")))
    return reduce(DataFrame.unionByName, out)


def case_violations(cases: DataFrame, documents: DataFrame, singles: int = 2, categories: dict[str, int] | None = None) -> DataFrame:
    """What is wrong with a set of cases: rule, subject, n; no rows for a valid set.

    ``cases``: case_id, category, question, document_ids, quotes; ``documents``:
    document_id, text. Questions are neither blank nor repeated; named
    documents exist; a quote's key is in its document's; each document has
    ``singles`` cases of its own; ``categories``, if given, are met to a case.
    """
    q = F.coalesce(normal_space(F.col("question")), F.lit(""))
    one = F.lit(1).cast("long").alias("n")
    blank = cases.where(q == "").select(F.lit("blank question").alias("rule"), F.col("case_id").cast("string").alias("subject"), one)
    repeated = cases.where(q != "").groupBy(q.alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated question").alias("rule"), "subject", "n")
    named = cases.select("case_id", "category", F.size("document_ids").alias("size"), F.explode(F.arrays_zip("document_ids", "quotes")).alias("d")).select("case_id", "category", "size", F.col("d.document_ids").alias("document_id"), F.col("d.quotes").alias("quote")).where("document_id IS NOT NULL")
    ids = documents.select("document_id")
    unknown = named.join(ids, "document_id", "left_anti").select(F.lit("unknown document").alias("rule"), F.col("case_id").cast("string").alias("subject"), one)
    texts = documents.select("document_id", document_key(F.coalesce("text", F.lit(""))).alias("whole"))
    missing = named.where(F.coalesce("quote", F.lit("")) != "").join(texts, "document_id").where(~F.col("whole").contains(document_key(F.col("quote")))).select(F.lit("quote not in document").alias("rule"), F.col("case_id").cast("string").alias("subject"), one)
    own = named.where((F.col("size") == 1) & F.col("category").isin("direct_fact", "procedure_condition")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    uneven = ids.join(own, "document_id", "left").select(F.lit("cases of document").alias("rule"), F.col("document_id").cast("string").alias("subject"), F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != singles)
    found = [blank, repeated, unknown, missing, uneven]
    if categories is not None:
        want = cases.sparkSession.createDataFrame([*categories.items()], "subject string, want long")
        have = cases.groupBy(F.col("category").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
        off = have.join(want, "subject", "full").select(F.lit("cases of category").alias("rule"), "subject", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("want", F.lit(0)).alias("want"))
        found.append(off.where("n <> want").drop("want"))
    return reduce(DataFrame.unionByName, found)


def manifest_violations(manifest: DataFrame, least: int = 500, matrix: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """What is wrong with a data set's files: rule, subject, n; no rows for a valid set.

    ``manifest``: alias, title, path, source, format, sha256, content (bytes),
    text (what was extracted). Aliases, titles and paths are unique; the
    digest is the content's; PDF and word-processor files begin as such, pages hold no
    active or navigation element; texts have ``least`` ideographs and no two
    one key; ``matrix``, if given, holds the number of each (source, format).
    """
    one = F.lit(1).cast("long").alias("n")

    def repeats(rule: str, key: Column, subject: Column) -> DataFrame:
        return manifest.groupBy(key.alias("k")).agg(F.min(subject).cast("string").alias("subject"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "subject", "n")

    def breaks(rule: str, wrong: Column) -> DataFrame:
        return manifest.where(F.coalesce(wrong, F.lit(True))).select(F.lit(rule).alias("rule"), F.col("path").alias("subject"), one)

    head = lambda n: F.hex(F.substring("content", 1, n))
    active = F.lower(F.col("text_of_page")).rlike(r"<(?:script|style|nav|template)\b")
    found = [repeats(f"repeated {c}", F.col(c), F.col(c)) for c in ("alias", "title", "path")]
    found.append(repeats("repeated content", F.sha2(document_key(F.coalesce("text", F.lit(""))), 256), F.col("path")))
    found.append(breaks("digest", F.sha2("content", 256) != F.col("sha256")))
    found.append(breaks("signature", ((F.col("format") == "pdf") & (head(5) != "255044462D")) | ((F.col("format") == "docx") & (head(4) != "504B0304"))))
    page = manifest.where("format = 'html'").withColumn("text_of_page", F.decode("content", "UTF-8"))
    found.append(page.where(active).select(F.lit("active element").alias("rule"), F.col("path").alias("subject"), one))
    found.append(breaks("too short", ideographs(F.coalesce("text", F.lit(""))) < least))
    if matrix is not None:
        want = manifest.sparkSession.createDataFrame([(*k, v) for k, v in matrix.items()], "source string, format string, want long")
        have = manifest.groupBy("source", "format").agg(F.count(F.lit(1)).alias("n")).join(want, ["source", "format"], "full")
        off = have.select(F.lit("files of source and format").alias("rule"), F.concat_ws("/", "source", "format").alias("subject"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("want", F.lit(0)).alias("want"))
        found.append(off.where("n <> want").drop("want"))
    return reduce(DataFrame.unionByName, found)
