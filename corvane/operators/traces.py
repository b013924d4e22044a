"""Spans of a run's stages from its start and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.operators.greedy import Chooser, streamed

START, END, FAIL = "START", "END", "FAIL"
SCHEMA = "stage string, attempt int, depth int, started long, ended long, status string, duration long, self_time long"


class Spans(Chooser):
    """A stack of open stages. A run's open stages are all that is held.

    An end closes the innermost open span of its stage; spans inside it that are still open end with it, ABANDONED. An
    end without a start is a span of its own, UNMATCHED. A stage that starts again counts its attempts; self time is a span's
    duration without that of the spans directly inside. What is open at the end of the run stays OPEN, without an end.
    """

    def __init__(self):
        self.run, self.open, self.attempts = None, [], {}

    def _close(self, at: int | None, status: str) -> tuple:
        span = self.open.pop()
        duration = None if at is None else at - span["started"]
        if self.open and duration is not None:
            self.open[-1]["inside"] += duration
        return (self.run, span["stage"], span["attempt"], len(self.open), span["started"], at, status, duration, None if duration is None else duration - span["inside"])

    def take(self, row: dict) -> list[tuple]:
        self.run, stage, at = row["run_id"], row["stage"], row["at"]
        if row["kind"] == START:
            self.attempts[stage] = self.attempts.get(stage, 0) + 1
            self.open.append({"stage": stage, "attempt": self.attempts[stage], "started": at, "inside": 0})
            return []
        if row["kind"] not in (END, FAIL):
            return []
        if all(s["stage"] != stage for s in self.open):
            return [(self.run, stage, None, len(self.open), None, at, "UNMATCHED", None, None)]
        out = []
        while self.open[-1]["stage"] != stage:
            out.append(self._close(at, "ABANDONED"))
        return [*out, self._close(at, "DONE" if row["kind"] == END else "FAILED")]

    def end(self) -> list[tuple]:
        return [self._close(None, "OPEN") for _ in range(len(self.open))]


def spans(events: DataFrame) -> DataFrame:
    """run_id, stage, attempt, depth, started, ended, status, duration, self_time of the spans of ``events``: run_id, seq, at, stage, kind.

    A run's events count in the order of ``seq`` and ``at`` (numbers, as milliseconds); other kinds than START, END and FAIL are left out. A null
    run is a run, a null stage a stage. Runs of any length are streams.
    """
    rows = events.select("run_id", "seq", "at", "stage", "kind")
    return streamed(rows, "run_id", ["seq", "at", "stage", "kind"], Spans, f"run_id {rows.schema['run_id'].dataType.simpleString()}, {SCHEMA}")
