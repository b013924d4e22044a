import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, ingest, quality, scope
from corvane.operators.scope import MetadataFilter
from corvane.sources import imports, parsers

MD = """# Guide {#top}

Intro line one
line two

## Setup
- one
- two

| a | b |
|---|---|
| 1 | 2 |

```sql
# not a heading

SELECT 1
```
### Deep
text | with bar
## Next
end"""


def test_markdown(spark):
    got = parsers.markdown_blocks(spark.createDataFrame([(1, MD)], "document_id long, text string")).orderBy("order_index").collect()
    assert [(r.type, r.text.split("\n")[0]) for r in got] == [
        ("TITLE", "Guide"), ("PARAGRAPH", "Intro line one"), ("HEADING", "Setup"), ("LIST", "- one"), ("TABLE", "| a | b |"), ("CODE", "# not a heading"), ("HEADING", "Deep"), ("PARAGRAPH", "text | with bar"), ("HEADING", "Next"), ("PARAGRAPH", "end"),
    ]
    assert got[7].heading_path == ["Guide", "Setup", "Deep"] and got[9].heading_path == ["Guide", "Next"] and got[5].language == "sql"
    assert (got[4].line_start, got[4].line_end) == (10, 12) and got[5].text == "# not a heading\n\nSELECT 1"


def test_html():
    page = "<html><head><title>T &amp; x</title><style>p{}</style></head><body><nav><li>menu</li></nav><h1>T &amp; x</h1><p>One<p>Two <b>bold</b><ul><li>a<p>b</p></li></ul><table><tr><th>h</th></tr><tr><td>c|d</td></tr></table><pre>x\n  y</pre><img alt='pic'><script>bad()</script></body></html>"
    assert parsers.page_blocks(page) == [("TITLE", 1, "T & x"), ("PARAGRAPH", None, "One"), ("PARAGRAPH", None, "Two bold"), ("LIST", None, "ab"), ("TABLE", None, "| h |\n| --- |\n| c\\|d |"), ("CODE", None, "x\n  y"), ("CAPTION", None, "pic")]
    assert parsers.page_blocks("") == [("TITLE", 1, "document")]


def test_plain_text_and_offsets(spark):
    blocks = parsers.text_blocks(spark.createDataFrame([(1, "a  b\r\n c\n\n \nd😀\n\n")], "document_id long, text string"))
    got = ingest.map_offsets(blocks).orderBy("order_index").collect()
    assert [(r.text, r.source_start, r.source_end) for r in got] == [("a b\nc", 0, 5), ("d😀", 7, 10)]


def test_chunks_respect_limits_and_map_back(spark):
    text = "\n".join(f"## S{i}\nSentence {i} goes on; and more of it here! Yes.\n\n" + "word " * (15 * i) for i in range(1, 9))
    blocks = parsers.markdown_blocks(spark.createDataFrame([(1, text)], "document_id long, text string"))
    policy = chunking.Policy(80, 100, 10, 20, 28, 5, "p")
    chunks = chunking.parent_child(blocks, policy)
    rows = chunks.collect()
    parents, children = [r for r in rows if r.type == "PARENT"], [r for r in rows if r.type == "CHILD"]
    assert parents and children and {c.parent_id for c in children} == {p.chunk_id for p in parents}
    assert max(p.tokens for p in parents) <= 100 and max(c.tokens for c in children) <= 28
    texts = {r.chunk_id: r.text for r in rows}
    source = {b.order_index: b.text for b in blocks.collect()}
    for m in chunking.source_map(chunks).collect():
        assert texts[m.chunk_id][m.chunk_start : m.chunk_end] == source[m.order_index][m.block_start : m.block_end]
    assert rows[0].chunk_id == chunking.parent_child(blocks, policy).collect()[0].chunk_id
    marked = chunks.withColumns({"heading_only": F.lit(False), "has_code": F.lit(False), "mapped": F.lit(True)})
    report = quality.chunk_quality(marked, 20, 28, 80, 100).first()
    assert report.parents == len(parents) and report.over_limit == report.orphans == 0


def chunks_of(spark, blocks, *policy):
    """Chunks of one document's blocks (type, level, text, heading_path), by kind, in order."""
    rows = [(1, i, *b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "document_id long, order_index int, type string, level int, text string, heading_path array<string>")
    got = chunking.parent_child(df, chunking.Policy(*policy)).orderBy("type", "order_index").collect()
    return [r for r in got if r.type == "PARENT"], [r for r in got if r.type == "CHILD"]


def test_chunks_overlap_by_whole_units_but_not_across_headings(spark):
    rules = "".join(f"Rule {i} says something short; " for i in range(60))
    parents, children = chunks_of(spark, [("HEADING", 1, "A", ["A"]), ("PARAGRAPH", None, rules, ["A"]), ("HEADING", 1, "B", ["B"]), ("PARAGRAPH", None, "Last words of B.", ["B"])], 80, 100, 10, 20, 28, 8)
    assert all(p.tokens <= 100 for p in parents) and all(c.tokens <= 28 for c in children)
    own = [c.text for c in children if "Rule" in c.text]
    assert all(t.startswith(("Rule", "A")) for t in own)
    met = [i for t in own for i in __import__("re").findall(r"Rule (\d+)", t)]
    assert set(met) == {str(i) for i in range(60)} and len(met) > 60  # all are there, some twice
    assert parents[-1].text == "B\n\nLast words of B." and all("Last words" not in p.text for p in parents[:-1])


def test_chunks_section_change_and_short_tail(spark):
    para = lambda n, path: ("PARAGRAPH", None, "word " * n, path)
    parents, _ = chunks_of(spark, [para(60, ["A"]), para(10, ["B"])], 80, 100, 10, 20, 28, 5)
    assert len(parents) == 2 and parents[1].text.count("word") == 10  # a section long enough ends with its heading
    parents, _ = chunks_of(spark, [para(20, ["A"]), para(10, ["B"])], 80, 100, 10, 20, 28, 5)
    assert len(parents) == 1
    # 20 + 5 tokens fit one child of 28; 20 + 12 don't
    assert [c.tokens for c in chunks_of(spark, [para(20, []), para(5, [])], 80, 100, 10, 20, 28, 0)[1]] == [25]
    assert [c.tokens for c in chunks_of(spark, [para(20, []), para(12, [])], 80, 100, 10, 20, 28, 0)[1]] == [20, 12]


def test_chunks_keep_statements_and_words_whole(spark):
    code = "".join(f"call_number_{i}(\n  some, arguments, here\n);\n\n" for i in range(20))
    _, children = chunks_of(spark, [("CODE", None, code, [])], 200, 240, 0, 40, 60, 0)
    assert len(children) > 2 and not any(c.text.startswith(")") for c in children) and "".join(p.unit_text for c in children for p in c.pieces) == code
    words = " ".join(f"volatility_measure_{i}" for i in range(200))
    _, children = chunks_of(spark, [("PARAGRAPH", None, words, [])], 80, 100, 0, 20, 28, 0)
    assert all(c.tokens <= 28 and all(w in words.split() for w in c.text.split()) for c in children)
    _, children = chunks_of(spark, [("PARAGRAPH", None, "x" * 1000, [])], 80, 100, 0, 20, 28, 0)
    assert all(c.tokens <= 28 for c in children) and "".join(c.text for c in children) == "x" * 1000
    assert chunks_of(spark, [("PARAGRAPH", None, " \n", []), ("PARAGRAPH", None, None, [])], 80, 100, 10, 20, 28, 5) == ([], [])


def test_parse_quality(spark):
    rows = [(1, 0, "PARAGRAPH", "short", None), (2, 0, "PARAGRAPH", "x" * 60_000, 1), *[(3, i, "PARAGRAPH", "a repeated line of some length", 1) for i in range(4)], (4, 0, "PARAGRAPH", "ok � text that is long enough for a page", 1)]
    blocks = spark.createDataFrame(rows, "document_id long, order_index int, type string, text string, page int")
    got = {r.document_id: (r.issues, r.score, r.status) for r in quality.parse_quality(blocks, spark.createDataFrame([(2, 4)], "document_id long, page_count int")).collect()}
    assert got[1] == (["CONTENT_TOO_SHORT"], 20, "FAIL") and got[2] == (["SPARSE_PDF_TEXT_LAYER", "OVERSIZED_BLOCK"], 55, "WARNING")
    assert got[3] == (["REPEATED_CONTENT"], 80, "WARNING") and got[4][0] == ["EXCESSIVE_REPLACEMENT_CHARACTERS"]


def test_version_diff(spark):
    s = "document_id long, position int, hash string"
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], s)
    new = spark.createDataFrame([(1, 0, "b"), (1, 1, "x"), (1, 4, "y")], s)
    assert {(r.position, r.hash, r.change) for r in ingest.version_diff(old, new).collect()} == {(0, "b", "UNCHANGED"), (1, "x", "MODIFIED"), (4, "y", "ADDED"), (2, "c", "REMOVED"), (3, "d", "REMOVED")}


def test_reuse_upsert_and_publish(spark):
    chunks = spark.createDataFrame([(1, "h", "p"), (2, "h", "p"), (3, "g", "p"), (4, "h", "q")], "chunk_id long, hash string, policy string")
    assert [tuple(r) for r in ingest.reuse_embeddings(chunks, spark.createDataFrame([(2,)], "chunk_id long")).collect()] == [(1, 2)]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(tuple(r) for r in ingest.upsert(t, spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string"), ["id"], [F.desc("v")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(tuple(r) for r in ingest.insert_new(t, spark.createDataFrame([(2, "z"), (9, "n")], "id long, v string"), ["id"]).collect()) == [(1, "a"), (2, "b"), (9, "n")]


def test_filters_are_checked_before_the_plan():
    for bad in (("x;y", "EQ", "TEXT"), ("x", "GT", "TEXT"), ("x", "IN", "TEXT"), ("x", "CONTAINS", "NUMBER")):
        with pytest.raises(ValueError):
            MetadataFilter(*bad, value=1)


def test_metadata_conditions(spark):
    df = spark.createDataFrame([(1, '{"n": 5, "t": ["a", "b"], "d": "2024-01-02"}'), (2, '{"n": 50}'), (3, "{}")], "id long, m string")
    keep = lambda f: [r.id for r in df.where(scope.metadata_predicate(f, F.col("m"))).collect()]
    assert keep(MetadataFilter("n", "GTE", "NUMBER", 6)) == [2] and keep(MetadataFilter("n", "NE", "NUMBER", 5)) == [2]
    assert keep(MetadataFilter("t", "IN", "TEXT_LIST", values=("b", "z"))) == [1] and keep(MetadataFilter("d", "LT", "DATE", "2024-02-01")) == [1]


def test_validity_is_half_open(spark):
    at = F.lit("2024-01-02").cast("timestamp")
    rows = [(1, "2024-01-01", "2024-01-02"), (2, "2024-01-02", None), (3, None, None), (4, "2024-01-03", None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").select("id", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert [r.id for r in df.where(scope.effective(at, F.col("a"), F.col("b"))).collect()] == [2, 3]


def test_imports(spark):
    rows = [(1, "A.txt", "1.5", "x, y"), (2, "a.TXT", "z", ""), (3, "", None, None)]
    got = imports.manifest(spark.createDataFrame(rows, "row_no int, file_name string, size string, tags string"), {"size": ("NUMBER", True), "tags": ("TEXT_LIST", False)}).orderBy("row_no").collect()
    assert [r.errors for r in got] == [[], ["file_name: first in row 1", "size: not number"], ["file_name: missing", "size: missing"]] and got[0].tags == ["x", "y"]
    assert imports.check_header(["A", "b", "B"], ["a", "b"], ["a", "c"]) == ["repeated column: b", "missing column: c"]
    bundle = spark.createDataFrame([(1, "What  is"), (2, "what is ")], "case_id long, question string")
    assert [tuple(r) for r in imports.repeated_questions(bundle).collect()] == [("what is", 2, 1)]


def test_bundle_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([(1, "q")], "case_id long, question string")
    imports.write_bundle(cases, str(tmp_path / "b"))
    assert imports.read_bundle(spark, str(tmp_path / "b"), "case_id long, question string").collect() == cases.collect()


def test_sheets_and_margins(spark):
    cells = spark.createDataFrame([("s", 1, 2, "h"), ("s", 1, 3, "k"), ("s", 2, 3, "v|w"), ("s", 5, 1, "z"), ("s", 4, 1, " ")], "sheet string, row long, col long, value string")
    got = parsers.sheet_regions(cells).orderBy("region").collect()
    assert [(r.first_row, r.last_row) for r in got] == [(1, 2), (5, 5)] and got[0].text == "| h | k |\n| --- | --- |\n|  | v\\|w |"
    lines = spark.createDataFrame([(1, p, f"Page {p}") for p in range(4)] + [(1, 0, "once")], "document_id long, page int, text string")
    assert [r.norm for r in parsers.repeated_margins(lines).collect()] == ["page #"]


def test_candidate_spans_cover_their_parents(spark):
    from corvane.operators.chunking import candidate_spans

    texts = ["One two. Three four! Five six? Seven.", "no stop " * 200 + "end. Same words here. Same words here. Same words here.", "!!! a b; c\n\nd", "日本語" * 90 + "。また", "x" * 900]
    parents = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "document_id long, chunk_id string, text string")
    asked = spark.createDataFrame([(i, str(i), "same words", "Same words") for i in range(len(texts))], "query_id long, parent_id string, focus string, anchor string")
    got = candidate_spans(parents, asked, limit=30, most=10**6).collect()
    for i, t in enumerate(texts):
        own = sorted((r.start, r.end) for r in got if r.query_id == i)
        assert "".join(t[a:b] for a, b in own) == t and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert all(r.tokens <= 30 for r in got) and len({r.span_id for r in got}) == len(got)


def scanned(text):
    """Cleaning written out as a scan, one place after the other."""
    import re

    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("---\n") and "\n---\n" in text[3:]:
        text = text[text.index("\n---\n", 3) + 5 :]
    out, plain, i = [], "", 0

    def flush():
        nonlocal plain
        lines = plain.split("\n")
        for n in range(1, len(lines) - 1):
            if re.fullmatch(r"[ \t]*((import|export)[ \t].*|(?i:\[toc\]|table of contents|目录)[ \t]*)", lines[n]):
                lines[n] = ""
        out.append("\n".join(lines))
        plain = ""

    while i < len(text):
        rest = text[i:]
        if rest.startswith("```"):
            end = rest.find("```", 3)
            flush(), out.append(rest if end < 0 else rest[: end + 3])
            i += len(rest) if end < 0 else end + 3
        elif m := re.match(r"`[^`\n]+`", rest):
            flush(), out.append(m[0])
            i += len(m[0])
        elif rest.startswith("<!--"):
            end = rest.find("-->", 4)
            flush()
            i += len(rest) if end < 0 else end + 3
        elif m := re.match(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>", rest) or re.match(r"</?[A-Za-z][^<>]*>", rest):
            flush(), out.append("\n" if re.fullmatch(r"(?i)<br\s*/?>", m[0]) else "")
            i += len(m[0])
        elif m := re.match(r"!?\[([^\]\n]*)\]\([^)\n]*\)", rest):
            flush(), out.append(m[1])
            i += len(m[0])
        elif m := re.match(r"(?s)\{\{.*?\}\}", rest):
            flush()
            i += len(m[0])
        elif rest[0] in "`<![{":
            flush(), out.append(rest[0])
            i += 1
        else:
            plain += rest[0]
            i += 1
    flush()
    return "".join(out)


def test_cleaning_by_a_written_out_scan(spark):
    import random

    from corvane.sources.cleaning import clean_markdown

    parts = ["word ", "\n", "\r\n", "```\n<!-- kept -->\n```", "`<b>`", "<!-- c -->", "<br/>", "<BR>", "<b>", "</b>", "<script>x < 1</script>", "![alt](a.png)", "[label](http://x)", "{{< tab >}}", "a < b", "[x]", "!", "{", "\nimport x from 'y'\n", "\nTable of Contents\n", "目录", "`", "<!-- open", "--- "]
    rng = random.Random(3)
    texts = ["", "---\ntitle: T\n---\nbody", "```open fence [a](b)"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").select("i", clean_markdown(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {**{i: scanned(t) for i, t in enumerate(texts)}, -1: None}


def test_code_that_holds_a_fence_has_a_longer_one(spark):
    rows = [(1, 0, "CODE", "a = 1", "py"), (2, 0, "CODE", "```\nx\n```", None), (3, 0, "CODE", "`````", "md"), (4, 0, "CODE", "a `b` c", None)]
    df = spark.createDataFrame(rows, "document_id long, order_index int, type string, text string, language string")
    got = {r.document_id: r.render for r in chunking.parent_child(df).where("type = 'PARENT'").collect()}
    assert got == {1: "```py\na = 1\n```", 2: "````\n```\nx\n```\n````", 3: "``````md\n`````\n``````", 4: "```\na `b` c\n```"}


def test_stretches_of_a_document_are_chunked_as_the_whole(spark):
    import random

    r = random.Random(12)
    rows = []
    for d in range(6):
        for i in range(90):
            kind, level = r.choice([("HEADING", 1), ("HEADING", 2), ("TITLE", None), ("PARAGRAPH", None), ("PARAGRAPH", None), ("CODE", None), ("LIST", None)])
            path = [f"h{r.randint(0, 2)}", f"s{r.randint(0, 2)}"] if r.random() < 0.5 else None
            rows.append((d, i, kind, level, " ".join(r.choices(["word", "other.", "long-ish", "x = 1;", "end!"], k=r.choice([1, 3, 9, 40]))), path))
    df = spark.createDataFrame(rows, "document_id long, order_index int, type string, level int, text string, heading_path array<string>")
    for policy in (chunking.Policy(30, 45, 6, 10, 14, 3, "small"), chunking.Policy(160, 190, 20, 40, 55, 8, "middle")):
        whole, split = (sorted(map(repr, chunking.parent_child(df, policy, split=x).collect())) for x in (False, True))
        assert whole == split
    assert chunking.stretches(df).select("document_id", "stretch").distinct().count() > 30


def test_one_long_document_is_folded_in_several_tasks(spark):
    text = [("HEADING", 1, f"Part {i}") if i % 40 == 0 else ("PARAGRAPH", None, f"Sentence number {i} of this part.") for i in range(4000)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(text)], "document_id long, order_index int, type string, level int, text string")
    dealt = chunking.stretches(df).repartition(8, "document_id", "stretch").withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > 4
    got = chunking.parent_child(df)
    assert got.where("type = 'PARENT'").agg(F.count_distinct("parent_no"), F.max("parent_no")).first() == (n := got.where("type = 'PARENT'").count(), n - 1) and n >= 100


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_texts_move_once_to_be_chunked(spark):
    text = "\n\n".join(f"# h{i}\n\nOne two three. Four five six.\n\n- a\n- b" for i in range(40))
    df = spark.createDataFrame([(i, text) for i in range(3)], "document_id long, text string")
    blocks = parsers.markdown_blocks(df)
    here, dealt = (chunking.parent_child(blocks, chunking.Policy(20, 30, 4, 8, 12, 2, "t"), deal=x) for x in (False, True))
    assert moves(here) == 1 and moves(here) < moves(dealt)
    assert sorted(map(repr, here.collect())) == sorted(map(repr, dealt.collect()))


def test_chunk_quality_moves_no_chunks_that_lie_by_document(spark):
    schema = "document_id long, chunk_id string, parent_id string, type string, text string, render string, header string, tokens int, heading_only boolean, has_code boolean, mapped boolean"
    rows = [(1, "p", None, "PARENT", " x ", "x", "", 500, False, False, True), (1, "c", "p", "CHILD", "x", "x", "", 300, False, False, True), (1, "d", "q", "CHILD", "y", "y", "", 300, False, False, True), (1, "e", None, "CHILD", "z", "z", "", 300, False, False, True), (2, "p", None, "PARENT", None, "x", "", 500, False, False, True), (2, "c", "p", "CHILD", None, "x", "", 300, False, False, True)]
    df = spark.createDataFrame(rows, schema).repartition("document_id")
    report = quality.chunk_quality(df)
    assert moves(report) == 1
    assert sorted((r.document_id, r.parents, r.children, r.orphans, r.one_child, r.identical) for r in report.collect()) == [(1, 1, 3, 2, 1, 1), (2, 1, 1, 0, 1, 0)]
