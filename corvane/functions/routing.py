"""Question routing: signal patterns and the decision tree as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import canonical_space, document_references

#: Patterns of the routing signals, in the order in which they name the reason (fixed values).
SIGNALS = [
    ("MULTI_GOAL", "同时|分别|依次|独立目标|(?:两个|三个|多个)(?:独立)?目标|多意图|各自|逐一|不要.{0,8}合并", "auto-deep-multi-goal"),
    ("STAGED_TASK", "第一阶段|第二阶段|第三阶段|三阶段|多阶段|分阶段|依次处理", "auto-deep-staged-task"),
    ("SYNTHESIS", "综合|跨文档|多份(?:文档|资料)|多个(?:文档|资料)|汇总.{0,8}(?:文档|资料)", "auto-deep-synthesis"),
    ("COMPARISON", "比较|对比|差异|异同|权衡|优缺点|优势.{0,6}劣势|区别", "auto-deep-comparison"),
    ("CONFLICT", "冲突|矛盾|相互印证|交叉验证", "auto-deep-conflict"),
]
#: Words that ask for a cause (fixed value).
CAUSE = "根因|原因|为什么|为何"
#: Words that ask for a remedy (fixed value).
REMEDIATION = "修复|解决|方案|措施|处置|恢复|改进"
#: Phrases that look one thing up (fixed value).
DIRECT_LOOKUP = "根据《|在《|文档.{0,8}(?:说明|给出)|部分.{0,8}(?:关键信息|要求|做法)|(?:关键信息|要求|做法)是什么"
#: Phrases that ask whether something is stated (fixed value).
AVAILABILITY = "是否.{0,16}(?:给出|包含|规定|说明|提供)|有没有.{0,16}(?:给出|包含|规定|说明|提供)"
#: A technical term: at least three characters, not part of a longer one (fixed value).
TECHNICAL = r"(?<![A-Za-z0-9_.-])[A-Za-z][A-Za-z0-9_.-]{2,}(?![A-Za-z0-9_.-])"
#: Common words, which aren't terms (fixed values).
COMMON_WORDS = ["what", "how", "why", "which", "when", "who", "the", "and", "for", "from", "into", "with", "without", "does", "are", "can", "should"]
#: Words by which a question is small talk, or about the organization (fixed values).
GREETING = "^(你好|您好|嗨|hello|hi|hey|谢谢|多谢|在吗|你是谁|你能做什么)[！!。.?？ ]*$"
GREETING_WORDS = ["你好", "您好", "hello", "hi"]
ABOUT_YOU = ["你是谁", "介绍你", "介绍一下你", "身份", "能做什么", "能提供", "可以帮"]
ORGANIZATION = ["我们公司", "本公司", "公司内部", "内部制度", "内部资料", "本项目", "我们的项目", "知识库", "部门", "组织", "研发规范", "员工", "权限", "版本发布"]
#: Words that refer to what was said before (fixed value).
REFERS_BACK = "它|这个|上面|刚才|其|该|他们|those|that|it"


def deep_signals(question: Column) -> Column:
    """The signals that veto the fast mode, in the order of their weight."""
    q = canonical_space(question)
    flags = [F.when(document_references(q) >= 2, F.lit("MULTI_DOCUMENT"))]
    flags += [F.when(q.rlike(pattern), F.lit(name)) for name, pattern, _ in SIGNALS]
    flags.append(F.when(q.rlike(CAUSE) & q.rlike(REMEDIATION), F.lit("DIAGNOSE_AND_REPAIR")))
    return F.array_compact(F.array(*flags))


def technical_anchors(question: Column) -> Column:
    found = F.regexp_extract_all(canonical_space(question), F.lit(TECHNICAL), F.lit(0))
    return F.filter(found, lambda t: ~F.lower(t).isin(COMMON_WORDS))


def route(question: Column) -> Column:
    """struct(mode, reason, signals) of a question; null counts as empty."""
    q = canonical_space(F.coalesce(question, F.lit("")))
    deep = deep_signals(q)
    reasons = {"MULTI_DOCUMENT": "auto-deep-multi-document", "DIAGNOSE_AND_REPAIR": "auto-deep-diagnose-repair"} | {n: r for n, _, r in SIGNALS}
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), F.get(deep, F.lit(0)))
    made = lambda mode, why, signals: F.struct(F.lit(mode).alias("mode"), why.alias("reason"), signals.alias("signals"))
    one = lambda s: F.array(F.lit(s))
    return (
        F.when(q == "", made("DEEP", F.lit("auto-deep-empty"), one("EMPTY_QUERY")))
        .when(F.size(deep) > 0, made("DEEP", reason, deep))
        .when((document_references(q) == 1) & q.rlike(DIRECT_LOOKUP), made("FAST", F.lit("auto-fast-explicit-document"), one("SINGLE_DOCUMENT_LOOKUP")))
        .when(q.rlike(AVAILABILITY), made("FAST", F.lit("auto-fast-simple-lookup"), one("SIMPLE_AVAILABILITY_LOOKUP")))
        .when(F.size(technical_anchors(q)) > 0, made("FAST", F.lit("auto-fast-technical-anchor"), one("STABLE_TECHNICAL_ANCHOR")))
        .otherwise(made("DEEP", F.lit("auto-deep-uncertain"), one("UNCERTAIN")))
    )


def reroute(decision: Column, title_hits: Column, strict: bool = False) -> Column:
    """The decision after a look at retrieved titles: enough of them in the question make a staged or multi-goal question fast.

    A staged question needs two titles; a multi-goal one needs two under the
    ``strict`` profile and one otherwise. Other decisions stay.
    """
    staged = F.array_contains(decision["signals"], "STAGED_TASK")
    eligible = (decision["mode"] == "DEEP") & (staged | F.array_contains(decision["signals"], "MULTI_GOAL"))
    enough = title_hits >= F.when(staged, 2).otherwise(2 if strict else 1)
    fast = F.lit("auto-fast-retrieval-aware-28" if strict else "auto-fast-retrieval-aware-50")
    made = lambda mode, why: F.struct(F.lit(mode).alias("mode"), why.alias("reason"), decision["signals"].alias("signals"))
    return F.when(eligible & enough, made("FAST", fast)).when(eligible, made("DEEP", F.lit("auto-deep-retrieval-confidence"))).otherwise(decision)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def knowledge_demand(question: Column) -> Column:
    """NONE, ORGANIZATION_SPECIFIC or GENERAL."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    small = q.rlike(GREETING) | ((F.length(q) <= 80) & _any(q, GREETING_WORDS) & _any(q, ABOUT_YOU))
    return F.when(small, "NONE").when(_any(q, ORGANIZATION), "ORGANIZATION_SPECIFIC").otherwise("GENERAL")


def needs_rewrite(question: Column, has_history: Column) -> Column:
    """Whether a question leans on what was said before."""
    return has_history & ((F.length(question) < 36) | question.rlike(REFERS_BACK))
