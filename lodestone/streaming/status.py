"""Task status: state machine, throttled updates, and their batch form."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "skipped")
ACTIVE = ("started", "in_progress")


def advance(state: str | None, event: str) -> str:
    """The state after an event; a state that has ended stays."""
    if state in TERMINAL:
        return state
    return {"start": "started", "progress": "in_progress", "complete": "completed", "fail": "failed", "skip": "skipped"}.get(event, state or "started")


def last_per_interval(updates: DataFrame, key: str, at: str, value: str, interval: str) -> DataFrame:
    """The last update of each key in each interval: what a throttled reporter shows in the end."""
    latest = F.max_by(value, F.struct(at, value)).alias(value)
    return updates.groupBy(key, F.window(at, interval).alias("_w")).agg(latest).select(key, value, F.col("_w.start").alias("w"))


def recover_stale(statuses: DataFrame) -> DataFrame:
    """At a start nothing is running yet, so what was active has failed."""
    active = F.col("state").isin(*ACTIVE)
    return statuses.withColumns({"state": F.when(active, "failed").otherwise(F.col("state")), "error": F.when(active, "interrupted by a restart").otherwise(F.col("error"))})


def throttle(updates: DataFrame, interval_ms: int, key: str = "id", state: str = "state", payload: str = "payload") -> DataFrame:
    """A stream of updates, at most one of each key an interval; ended tasks pass at once.

    The first update passes. Later ones replace each other until the interval is over; a
    processing-time timer then lets the last through. An ended task forgets its state.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Throttle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long")
            self.held = handle.getValueState("held", "state string, payload string")

        def _out(self, key: tuple, row: tuple) -> pd.DataFrame:
            return pd.DataFrame({"id": [key[0]], "state": [row[0]], "payload": [row[1]]})

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentProcessingTimeInMs()
            for pdf in rows:
                for s, p in zip(pdf["state"], pdf["payload"], strict=True):
                    if s in TERMINAL:
                        for t in list(self.handle.listTimers()):
                            self.handle.deleteTimer(t)
                        self.last.clear()
                        self.held.clear()
                        yield self._out(key, (s, p))
                    elif not self.last.exists() or now - self.last.get()[0] >= interval_ms:
                        self.last.update((now,))
                        self.held.clear()
                        yield self._out(key, (s, p))
                    else:
                        if not self.held.exists():
                            self.handle.registerTimer(self.last.get()[0] + interval_ms)
                        self.held.update((s, p))

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            if self.held.exists():
                row = self.held.get()
                self.held.clear()
                self.last.update((timerValues.getCurrentProcessingTimeInMs(),))
                yield self._out(key, row)

        def close(self) -> None:
            pass

    rows = updates.select(F.col(key).cast("string").alias("id"), F.col(state).alias("state"), F.col(payload).cast("string").alias("payload"))
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Throttle(), outputStructType="id string, state string, payload string", outputMode="Append", timeMode="ProcessingTime")


def replay(events: DataFrame, key: str = "id", order: str = "at", event: str = "event") -> DataFrame:
    """The state of each task after all its events, in order; a state that has ended stays.

    The first ending event decides; before one, the last event does. Both are aggregates, so no
    task's events have to meet in memory.
    """
    names = F.create_map(*[F.lit(x) for kv in (("start", "started"), ("progress", "in_progress"), ("complete", "completed"), ("fail", "failed"), ("skip", "skipped")) for x in kv])
    state = F.element_at(names, F.col(event))
    ended = state.isin(*TERMINAL)
    first = F.min_by(F.when(ended, state), F.when(ended, F.col(order)))
    last = F.max_by(F.when(~ended, state), F.when(~ended, F.col(order)))
    return events.groupBy(key).agg(F.coalesce(first, last, F.lit("started")).alias("state"))


def fan_out(updates: DataFrame, reporters: list, checkpoint: str, available_now: bool = True):
    """Give every micro-batch of a stream to each reporter; one that fails does not stop the others."""
    failures: list[str] = []

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        for report in reporters:
            try:
                report(batch, number)
            except Exception as e:  # noqa: BLE001  reporters are the caller's
                failures.append(f"{type(e).__name__}: {e}")
        batch.unpersist()

    writer = updates.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start(), failures
