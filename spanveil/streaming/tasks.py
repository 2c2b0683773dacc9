"""Task events as a stream: every change of a task's status, the last state of each task, and callers that have gone away."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def task_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events(task_id, ts timestamp, status): the newest state of each task; state is bounded by the watermark and an hour's windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "task_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))


#: What an event makes of a task's status; other events of that status are passed over. Polls change no status.
MOVES = {
    ("", "submit"): "pending",
    ("pending", "start"): "running",
    ("pending", "cancel"): "failed",
    ("running", "finish"): "finished",
    ("running", "fail"): "failed",
    ("running", "cancel"): "failed",
}
STATE = "status string, polled_at double, updated_at double"
MOVED = "task_id string, status string, progress double, resource_id string, error string, updated_at double"


def task_machine(events: DataFrame, late: str = "10 seconds", abandoned_after: float = 60.0, kept_for: float = 3600.0) -> DataFrame:
    """events(task_id, ts timestamp, event, detail) to a row for each change of a task's status.

    submit, start, poll, finish (detail: the resource), fail (detail: the error), cancel. A pending task that
    nobody has polled for ``abandoned_after`` seconds of event time fails; an ended one is
    ``expired`` and forgotten after ``kept_for`` seconds. Events of one batch are taken in the order of their times.
    """

    def run(key, frames, state: GroupState):
        status, polled, updated = state.get if state.exists else ("", 0.0, 0.0)
        out = []

        def move(to, at, error=None, resource=None):
            nonlocal status, updated
            status, updated = to, at
            out.append((key[0], to, {"finished": 1.0, "pending": 0.0}.get(to), resource, error, at))

        if state.hasTimedOut:
            if status == "pending":
                move("failed", polled + abandoned_after, "abandoned by the caller")
            else:
                move("expired", updated + kept_for)
        else:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for at, event, detail in zip(rows["ts"].astype("int64") / 10.0 ** (9 if rows["ts"].dtype == "datetime64[ns]" else 6), rows["event"], rows["detail"], strict=True):
                if event in ("submit", "poll"):
                    polled = max(polled, at)
                to = MOVES.get((status, event))
                if to:
                    error = {"fail": detail, "cancel": "cancelled"}.get(event)
                    move(to, at, error, detail if event == "finish" else None)
        if status == "expired":
            state.remove()
        elif status:
            state.update((status, polled, updated))
            if status != "running":
                due = polled + abandoned_after if status == "pending" else updated + kept_for
                state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "status", "progress", "resource_id", "error", "updated_at"])

    return events.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(run, MOVED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def polling_sessions(polls: DataFrame, gap: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """polls(task_id, ts timestamp): spells in which a caller kept asking; an ended spell without a result is an abandoned task."""
    return polls.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "task_id").agg(F.count("*").alias("polls")).select("task_id", F.col("session_window.start").alias("first_poll"), F.col("session_window.end").alias("expires"), "polls")


def redact_stream(docs: DataFrame, rules: dict[str, str] | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """docs(text) as they arrive, redacted by rules: no state, no shuffle."""
    from ..operators.detect import RULES, RuleDetector
    from ..operators.redact import redact

    rules = rules or RULES
    return redact(RuleDetector(rules).detect(docs, list(rules)), blacklist)
