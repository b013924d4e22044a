"""Health of evaluated runs: kinds of errors, the phase that failed, and research that came out degraded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What messages of refused credentials and of passing faults hold (fixed values).
AUTH_STATUS = r"HTTP\s+(401|403)"
AUTH_WORDS = "Unauthorized|Forbidden|authentication failed|authorization failed"
TRANSIENT_STATUS = r"http\s+(429|5[0-9]{2})"
TRANSIENT_WORDS = ["timed out", "timeout", "rate limit", "too many requests", "connection reset", "connection refused", "temporarily unavailable", "service unavailable"]
#: Phases by the words of a failure's message, the first that fits (fixed values).
PHASES = [
    ("TIMEOUT", ["timed out", "timeout"]),
    ("PROVIDER_AUTH", ["authentication", "unauthorized", "forbidden"]),
    ("ROUTING", ["routing", "router"]),
    ("EVIDENCE_JUDGE", ["judge", "coverage"]),
    ("DEEP_READ", ["deep", "evidence"]),
    ("RETRIEVAL", ["retriev", "search"]),
]
OTHER_PHASE = "RAG_RUN"
#: Pipelines whose runs must report diagnostics, and those that may judge each goal apart (fixed values).
CONTROLLED = ["agentic-rag-v4", "agentic-rag-v5", "agentic-rag-v7", "agentic-rag-v8", "deep-rag-final"]
JUDGED_BY_GOAL = ["agentic-rag-v8", "deep-rag-final"]


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def authentication_failure(error: Column) -> Column:
    """Whether a message says that credentials were refused (null: no)."""
    return F.coalesce(error.rlike(AUTH_STATUS) | error.rlike(AUTH_WORDS), F.lit(False))


def transient_failure(error: Column) -> Column:
    """Whether a message tells of a fault that may pass; refused credentials don't."""
    low = F.lower(error)
    return F.coalesce(~authentication_failure(error) & (_holds(low, TRANSIENT_WORDS) | low.rlike(TRANSIENT_STATUS)), F.lit(False))


def failure_phase(message: Column) -> Column:
    """The phase of a run that a failure's message points to; null without a message."""
    low = F.lower(message)
    out = F.when(low.isNull(), F.lit(None).cast("string"))
    for phase, words in PHASES:
        out = out.when(_holds(low, words), phase)
    return out.otherwise(OTHER_PHASE)


def _number(diagnostics: Column, key: str) -> Column:
    """A counter of a JSON object; 0 where it is missing or no number."""
    return F.coalesce(F.get_json_object(diagnostics, f"$.{key}").try_cast("double").cast("long"), F.lit(0))


def degradations(mode: Column, pipeline: Column, diagnostics: Column) -> Column:
    """Why a finished run is no healthy sample: an array of reasons, empty for a healthy one.

    Null where the rules don't hold: for runs that aren't DEEP and pipelines
    that aren't controlled. ``diagnostics`` is a JSON object; without one (null,
    or JSON of another kind) that is the reason. Runs from before logical
    failures were counted are judged by their failed attempts.
    """
    keys = F.json_object_keys(diagnostics)
    logical = F.when(F.array_contains(keys, "modelFailedLogicalCallCount"), _number(diagnostics, "modelFailedLogicalCallCount")).otherwise(_number(diagnostics, "modelFailedAttemptCount"))
    judged, goals = _number(diagnostics, "judgeCallCount"), _number(diagnostics, "primaryGoalCount")
    well_judged = (judged == 1) | (pipeline.isin(JUDGED_BY_GOAL) & (goals > 0) & (judged == goals))
    rules = [
        (_number(diagnostics, "failedSupportActionCount") > 0, "failed support action"),
        (logical > 0, "failed model logical call"),
        (_number(diagnostics, "hiddenEvidenceOutcomeCount") > 0, "hidden evidence outcome"),
        (~well_judged, "unexpected evidence judge call count"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(reason)) for rule, reason in rules]))
    applies = F.coalesce((mode == "DEEP") & pipeline.isin(CONTROLLED), F.lit(False))
    return F.when(applies, F.when(keys.isNull(), F.array(F.lit("diagnostics missing"))).otherwise(found))
