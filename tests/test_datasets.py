import html
import random
import re

from pyspark.sql import functions as F

from corvane.functions.text import document_key
from corvane.operators import datasets, health

IDEOGRAPH = r"[㐀-䶿一-鿿]"


def key(t):
    t = re.sub(r"(?<!\w)\d+[.)](?=\s)", "", html.unescape(t))
    return re.sub(r"[^0-9a-zA-Z㐀-䶿一-鿿]+", "", t).lower()


def test_document_key(spark):
    texts = ["1. Erste &amp; 2) zweite", "v1. x", "a3. b", "&#39;It&#x27;s&#39; 中文，3.5", "", None, "1. 2. 3. x", "&lt;b&gt;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.k for r in df.select("i", document_key(F.col("t")).alias("k")).collect()}
    assert got == {i: None if t is None else key(t) for i, t in enumerate(texts)}


def quotes(text, least=35, most=220):
    """The rule written out: a state for code and heading, carried over the blocks."""
    out, seen, heading, in_code = [], set(), "Document", False
    for n, block in enumerate(re.split(r"\n\s*\n", text)):
        block = block.strip()
        if block.startswith("```"):
            in_code = block.count("```") % 2 == 1
        if not block or in_code or block.startswith("```"):
            continue
        if m := re.fullmatch(r"#{1,6}\s+(.+)", block):
            heading = " ".join(re.sub("[`*_]", "", m[1]).split())
            continue
        size = lambda t: len(re.findall(IDEOGRAPH, t))
        if block[0] == "|" or block.count("|") > 8 or block.startswith("图片说明：") or size(block) < least:
            continue
        line = " ".join(block.split())
        stops = [i + 1 for i, c in enumerate(line[: most + 1]) if c in "。！？；" and size(line[: i + 1]) >= least]
        if stops:
            line = line[: stops[0]]
        elif len(line) > most:
            spaces = [i for i in range(120, most + 1) if line[i] == " "]
            line = line[: spaces[-1] if spaces else most]
        if size(line) >= least and key(line) not in seen:
            seen.add(key(line))
            out.append((n, heading, line))
    return out


def test_evidence_blocks_against_the_rule_written_out(spark):
    rng = random.Random(5)

    def block():
        kind = rng.random()
        words = "".join(rng.choice("安装配置集群节点服务 日志。！；，ab1") for _ in range(rng.choice([10, 60, 240, 500])))
        if kind < 0.15:
            return f"{'#' * rng.randrange(1, 8)} 第{rng.randrange(9)}节 *要点*"
        if kind < 0.25:
            return rng.choice(["```\ncode", "```\ncode\n```", "```"])
        if kind < 0.35:
            return rng.choice(["|", "图片说明：", "a|" * 9, "\n", "- ", "   "]) + words
        return words if kind < 0.9 else words.replace(" ", "")

    texts = ["\n\n".join(block() for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, "一" * 34, "一" * 35 + "\n \n" + "一" * 35, "字" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got = sorted((r.document_id, r.n, r.heading, r.quote) for r in datasets.evidence_blocks(df).collect())
    want = [(i, *q) for i, t in enumerate(texts) for q in quotes(t or "")]
    assert got == want and len(want) > 60


def test_cases_of_documents_and_pairs(spark):
    docs = spark.createDataFrame([(i, "s" if i < 5 else "z", f"T{i}") for i in range(7)], "document_id int, source string, title string")
    ev = spark.createDataFrame([(i, n, f"h{n}", f"- *quote* {i} {n}") for i in range(7) for n in range(3 if i != 3 else 1)], "document_id int, n int, heading string, quote string")
    cases = datasets.synthesize_cases(docs, ev, pairs=2)
    got = {(r.category, tuple(r.document_ids)): r for r in cases.collect()}
    assert sorted(k[1] for k in got if k[0] == "cross_document") == [(0, 1), (2, 4), (5, 6)]  # 3 has a single block
    assert sum(k[0] == "direct_fact" for k in got) == sum(k[0] == "procedure_condition" for k in got) == 6
    assert got["direct_fact", (0,)].question == "What does T0 state in its part h0?" and got["procedure_condition", (0,)].expected_answer == "quote 0 1"
    assert got["cross_document", (0, 1)].expected_answer == "T0: quote 0 0 T1: quote 1 0"
    assert datasets.synthesize_cases(docs.limit(0), ev).count() == 0
    texts = docs.select("document_id", F.concat(*[F.concat(F.lit("x "), F.lit(f"- *quote* "), F.col("document_id").cast("string"), F.lit(f" {n}\n")) for n in range(3)]).alias("text"))
    numbered = cases.withColumn("case_id", F.monotonically_increasing_id())
    assert {(r.rule, r.subject, r.n) for r in datasets.case_violations(numbered, texts).collect()} == {("cases of document", "3", 0)}


def test_what_is_wrong_with_cases(spark):
    kind = "case_id int, category string, question string, document_ids array<int>, quotes array<string>"
    cases = spark.createDataFrame([
        (1, "direct_fact", "a  b", [1], ["Some &amp; text"]), (2, "procedure_condition", "a b", [1], ["other"]), (3, "no_answer", None, [], []), (4, "cross_document", "c", [1, 9], ["some", "x"]), (5, "direct_fact", "d", [2], [None]),
    ], kind)
    docs = spark.createDataFrame([(1, "1. Some & TEXT here"), (2, None)], "document_id int, text string")
    got = {tuple(r) for r in datasets.case_violations(cases, docs, categories={"direct_fact": 2, "procedure_condition": 1, "cross_document": 2, "lost": 1, "no_answer": 1}).collect()}
    assert got == {("blank question", "3", 1), ("repeated question", "a b", 2), ("unknown document", "4", 1), ("quote not in document", "2", 1), ("cases of document", "2", 1), ("cases of category", "cross_document", 1), ("cases of category", "lost", 0)}
    assert datasets.case_violations(cases.limit(0), docs.limit(0)).count() == 0


def test_what_is_wrong_with_files(spark):
    import hashlib

    body = lambda t: (bytearray(t), hashlib.sha256(t).hexdigest())
    rows = []
    for i, (fmt, raw, text) in enumerate([("pdf", b"%PDF-1", "字甲" * 300), ("pdf", b"PDF", "字乙" * 300), ("docx", b"PK\x03\x04", "字丙" * 300), ("docx", b"PK", "字丁" * 300), ("html", b"<p>", "字戊" * 300), ("html", b"<NAV >", "字戊，" * 300), ("md", b"x", "短")]):
        content, digest = body(raw)
        rows.append((f"a{i}", "T" if i in (2, 4) else f"t{i}", f"p{i}", "s", fmt, "0" if i == 0 else digest, content, text))
    df = spark.createDataFrame(rows, "alias string, title string, path string, source string, format string, sha256 string, content binary, text string")
    got = {tuple(r) for r in datasets.manifest_violations(df, matrix={("s", "pdf"): 2, ("s", "docx"): 3, ("s", "html"): 2, ("s", "md"): 1}).collect()}
    assert got == {("repeated title", "T", 2), ("digest", "p0", 1), ("signature", "p1", 1), ("signature", "p3", 1), ("active element", "p5", 1), ("repeated content", "p4", 2), ("too short", "p6", 1), ("files of source and format", "s/docx", 2)}


def test_kinds_and_phases_of_failures(spark):
    rows = {
        None: (False, False, None), "": (False, False, "RAG_RUN"), "HTTP  403": (True, False, "RAG_RUN"), "http 403": (False, False, "RAG_RUN"), "Forbidden: timeout": (True, False, "TIMEOUT"),
        "HTTP 599 in search": (False, True, "RETRIEVAL"), "HTTP 600": (False, False, "RAG_RUN"), "Judge: Connection reset": (False, True, "EVIDENCE_JUDGE"), "a\nhttp\t429\nb router": (False, True, "ROUTING"), "unauthorized": (False, False, "PROVIDER_AUTH"),
    }
    df = spark.createDataFrame([(m,) for m in rows], "m string")
    m = F.col("m")
    got = {r.m: (r.a, r.t, r.p) for r in df.select("m", health.authentication_failure(m).alias("a"), health.transient_failure(m).alias("t"), health.failure_phase(m).alias("p")).collect()}
    assert got == rows


def test_degraded_runs(spark):
    good = '{"judgeCallCount": 1}'
    rows = [
        ("FAST", "agentic-rag-v8", None, None), ("DEEP", "other", None, None), (None, None, None, None), ("DEEP", "agentic-rag-v4", None, ["diagnostics missing"]), ("DEEP", "agentic-rag-v4", "[1]", ["diagnostics missing"]),
        ("DEEP", "agentic-rag-v4", good, []), ("DEEP", "agentic-rag-v4", "{}", ["unexpected evidence judge call count"]),
        ("DEEP", "agentic-rag-v8", '{"judgeCallCount": 3, "primaryGoalCount": 3}', []), ("DEEP", "agentic-rag-v7", '{"judgeCallCount": 3, "primaryGoalCount": 3}', ["unexpected evidence judge call count"]),
        ("DEEP", "agentic-rag-v8", '{"judgeCallCount": 0, "primaryGoalCount": 0}', ["unexpected evidence judge call count"]),
        ("DEEP", "agentic-rag-v5", '{"judgeCallCount": 1, "modelFailedAttemptCount": 2}', ["failed model logical call"]), ("DEEP", "agentic-rag-v5", '{"judgeCallCount": 1, "modelFailedAttemptCount": 2, "modelFailedLogicalCallCount": 0}', []),
        ("DEEP", "agentic-rag-v5", '{"judgeCallCount": 1, "failedSupportActionCount": "x", "hiddenEvidenceOutcomeCount": 1}', ["hidden evidence outcome"]),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, mode string, pipeline string, d string")
    got = {r.i: r.x for r in df.select("i", health.degradations(F.col("mode"), F.col("pipeline"), F.col("d")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]
