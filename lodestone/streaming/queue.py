"""The task queue: batch operations on its table, and a worker over a stream of tasks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import payload_number
from ..operators.relational import latest_per_key


def enqueue(queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """The queue with new tasks; a known key only gets the new priority and time."""
    fresh = latest_per_key(tasks, ["dedup_key"], F.desc("updated_at"))
    renamed = fresh.select("dedup_key", F.col("priority").alias("_p"), F.col("updated_at").alias("_u"))
    known = queue.join(renamed, "dedup_key", "left").withColumns({"priority": F.coalesce("_p", "priority"), "updated_at": F.coalesce("_u", "updated_at")}).select(*queue.columns)
    return known.unionByName(fresh.join(queue.select("dedup_key"), "dedup_key", "left_anti"), allowMissingColumns=True)


def dequeue(queue: DataFrame, operation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The task of highest priority, oldest first, and the queue without it."""
    rows = queue if operation is None else queue.where(F.col("type") == operation)
    head = rows.orderBy(F.desc("priority"), "created_at", "dedup_key").limit(1)
    return head, queue.join(head.select("dedup_key"), "dedup_key", "left_anti")


def page(queue: DataFrame, operation: str | None, limit: int, offset: int) -> DataFrame:
    """A page in priority order; the operation is filtered after paging, as callers expect."""
    rows = queue.orderBy(F.desc("priority"), "created_at", "dedup_key").offset(offset).limit(limit)
    return rows if operation is None else rows.where(F.col("type") == operation)


def reprioritise(queue: DataFrame, key: str, priority: int) -> DataFrame:
    return queue.withColumn("priority", F.when(F.col("dedup_key") == key, priority).otherwise(F.col("priority")))


def drain(queue: DataFrame, repository: int) -> DataFrame:
    return queue.where(~F.coalesce(payload_number(F.col("payload"), "repository_id") == repository, F.lit(False)))


def due(repos: DataFrame, now: datetime, interval: timedelta = timedelta(seconds=1800)) -> DataFrame:
    """Repositories never scanned or not since the interval."""
    return repos.where(F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") < F.lit(now - interval)))


def run_worker(tasks: DataFrame, handlers: dict[str, Callable[[dict], None]], report: Callable[[dict, str, str | None], None], checkpoint: str, available_now: bool = True):
    """Run a stream of tasks, each micro-batch in priority order; a failed task is reported, not repeated."""

    def work(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy(F.desc("priority"), "created_at").toLocalIterator():
            task = row.asDict()
            try:
                handlers[task["type"]](task)
                report(task, "completed", None)
            except Exception as e:  # noqa: BLE001  a task must not end the worker
                report(task, "failed", f"{type(e).__name__}: {e}")

    writer = tasks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def periodic(queue: DataFrame, repos: DataFrame, now: datetime, interval: timedelta = timedelta(seconds=1800)) -> DataFrame:
    """The repositories that a periodic check enqueues: those due, none as long as anything is queued."""
    waiting = queue.limit(1).agg(F.count("*").alias("_waiting"))
    return due(repos, now, interval).crossJoin(F.broadcast(waiting)).where("_waiting = 0").drop("_waiting")  # one row
