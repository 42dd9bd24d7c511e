"""Processor jobs as a stateful stream: one machine for each original, with timers for attempts that are due later.

Events of an original (it came or changed, it was deleted, a job ended or failed, a restart) go in; each change of a job
comes out as one row. The state is the original's item, its jobs and what of it is published, all small. Spark keeps it with
the stream's checkpoint: events that are replayed after a crash find the state of before and give the same rows again.

Rules: an item that changed cancels the active jobs made for what it was and asks for its extraction; a finished extraction
that is ready asks for knowledge, if there is a model, one that was skipped ends there; a deleted item removes its jobs. A
failure that isn't permanent is tried again after a delay that doubles. After a restart what was running is queued again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import ACTIVE, DETERMINISTIC, EXTRACTION, KNOWLEDGE
from ..operators.sync import DOUBLINGS, FIRST_DELAY, LAST_DELAY

#: What happened: ``item``, ``deleted``, ``started``, ``done``, ``failed``, ``restart``; ``seq`` orders equal times.
EVENT = "original_id string, at bigint, seq bigint, kind string, hash string, title string, mime string, job_id string, state string, error string, permanent boolean"
TRANSITION = "job_id string, original_id string, representation string, producer string, hash string, title string, mime string, state string, attempts int, retryable boolean, retry_at bigint, error string, at bigint, step int"


def delay(attempts: int) -> int:
    """Milliseconds before the next attempt, as ``operators.sync.retry_delay``."""
    return min(FIRST_DELAY * 2 ** min(max(attempts, 1) - 1, DOUBLINGS), LAST_DELAY)


def advance(state: dict[str, Any], event: dict[str, Any], model: str | None) -> list[dict[str, Any]]:
    """Change the state of an original by one event; the jobs that changed, as they are now."""
    jobs, changed = state.setdefault("jobs", []), []

    def put(job: dict[str, Any], **what: Any) -> None:
        job.update(what, at=event["at"])
        job["step"] = state["step"] = state.get("step", 0) + 1
        changed.append(dict(job))

    def queue(representation: str) -> None:
        state["number"] = state.get("number", 0) + 1
        job = {"job_id": f"{event['original_id']}/{state['number']}", "original_id": event["original_id"], "representation": representation, "producer": EXTRACTION if representation == DETERMINISTIC else model, **state["item"]}
        jobs.append(job)
        put(job, state="queued", attempts=0, retryable=False, retry_at=0, error=None)

    kind = event["kind"]
    named = next((j for j in jobs if j["job_id"] == event["job_id"]), None)
    if kind == "item":
        item = {k: event[k] for k in ("hash", "title", "mime")}
        if state.get("item") != item:
            for job in jobs:
                if job["state"] in ACTIVE:
                    put(job, state="cancelled", retry_at=0)
            state["item"], state["jobs"] = item, [j for j in jobs if j["state"] != "cancelled"]
            jobs = state["jobs"]
            queue(DETERMINISTIC)
    elif kind == "deleted":
        for job in jobs:
            put(job, state="removed", retry_at=0)
        state["jobs"], state["item"] = [], None
    elif kind == "started" and named and named["state"] == "queued":
        put(named, state="running")
    elif kind == "done" and named and named["state"] in ("queued", "running"):
        put(named, state="completed", error=None, retryable=False, retry_at=0)
        if named["representation"] == DETERMINISTIC and event["state"] == "ready" and model is not None:
            queue(KNOWLEDGE)
    elif kind == "failed" and named and named["state"] in ("queued", "running"):
        again, attempts = not event["permanent"], named["attempts"] + 1
        put(named, state="failed", error=event["error"], retryable=again, attempts=attempts, retry_at=event["at"] + delay(attempts) if again else 0)
    elif kind == "due":
        for job in jobs:
            if job["state"] == "failed" and job["retryable"] and 0 < job["retry_at"] <= event["at"]:
                put(job, state="queued")
    elif kind == "restart":
        for job in jobs:
            if job["state"] == "running":
                put(job, state="queued")
    return changed


class JobMachine(StatefulProcessor):
    """``advance`` with its state and timers kept by Spark."""

    def __init__(self, model: str | None = None):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("original", "value string")

    def _run(self, events: list[dict[str, Any]]) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        changed = [c for e in events for c in advance(state, e, self.model)]
        self.kept.update((json.dumps(state),))
        for job in changed:
            if job["state"] == "failed" and job["retryable"]:
                self.handle.registerTimer(job["retry_at"])
        if changed:
            yield pd.DataFrame(changed)[[c.split()[0] for c in TRANSITION.split(", ")]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").astype(object)
        yield from self._run(events.where(events.notna(), None).to_dict("records"))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._run([{"original_id": key[0], "kind": "due", "at": int(timerValues.getCurrentProcessingTimeInMs()), "job_id": None}])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of ``TRANSITION`` for a stream of ``EVENT``. The session keeps such state in RocksDB."""
    return events.groupBy("original_id").transformWithStateInPandas(JobMachine(model), TRANSITION, "Update", "ProcessingTime")
