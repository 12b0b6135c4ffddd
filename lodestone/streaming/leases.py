"""A task queue as streams: each task is leased, run on an executor, and reported once.

One stateful stream knows every task by its key. A new task is leased; a task that is known is not leased again.
A worker is another stream, over the leases: its handlers run in tasks on the executors, and what came of them is
written as reports, which go back into the first stream. A lease whose report does not come in time is given
out again, so a worker that is killed costs a delay and nothing else. The first report ends a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What the stateful stream reads, tasks and reports alike, and what it writes.
INPUT = "key string, type string, payload string, priority int, status string, error string"
OUTPUT = "key string, kind string, type string, payload string, priority int, attempt int, status string, error string"


def as_input(rows: DataFrame) -> DataFrame:
    """Tasks (dedup_key, type, payload, priority) as the input of :func:`lease`."""
    return rows.select(F.col("dedup_key").alias("key"), "type", F.col("payload").cast("string").alias("payload"), F.col("priority").cast("int").alias("priority"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"))


def lease(rows: DataFrame, lease_ms: int = 60_000, most_attempts: int = 5) -> DataFrame:
    """Leases and ends (kind ``lease`` or ``done``) of a stream of tasks and reports (see INPUT; a report has a status).

    Each task is leased when it first comes, and again whenever ``lease_ms`` pass without a report; after
    ``most_attempts`` leases it ends as ``failed``. A task ends once: with its first report. Tasks of a key that
    is known, and reports after the first one, change nothing. The session's state store must support timers (RocksDB).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Leases(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.task = handle.getValueState("task", "type string, payload string, priority int, attempt int")
            self.ended = handle.getValueState("ended", "status string")

        def _out(self, key: tuple, kind: str, task: tuple, status: str | None = None, error: str | None = None) -> pd.DataFrame:
            kind_, payload, priority, attempt = task
            return pd.DataFrame([(key[0], kind, kind_, payload, priority, attempt, status, error)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

        def _grant(self, key: tuple, task: tuple, now: int) -> pd.DataFrame:
            self.task.update(task)
            self.handle.registerTimer(now + lease_ms)
            return self._out(key, "lease", task)

        def _end(self, key: tuple, task: tuple, status: str, error: str | None) -> pd.DataFrame:
            self.ended.update((status,))
            self.task.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return self._out(key, "done", task, status, error)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                for kind, payload, priority, status, error in zip(pdf["type"], pdf["payload"], pdf["priority"], pdf["status"], pdf["error"], strict=True):
                    if self.ended.exists():
                        continue
                    known = self.task.get() if self.task.exists() else None
                    if status is not None and not pd.isna(status):
                        yield self._end(key, known or (kind, payload, _number(priority), 0), status, None if pd.isna(error) else error)
                    elif known is None:
                        yield self._grant(key, (kind, payload, _number(priority), 1), timerValues.getCurrentProcessingTimeInMs())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            if not self.task.exists():
                return
            kind, payload, priority, attempt = self.task.get()
            if attempt >= most_attempts:
                yield self._end(key, (kind, payload, priority, attempt), "failed", f"no report of {attempt} leases")
            else:
                yield self._grant(key, (kind, payload, priority, attempt + 1), timerValues.getCurrentProcessingTimeInMs())

        def close(self) -> None:
            pass

    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Leases(), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def _number(priority: Any) -> int | None:
    return None if priority is None or pd.isna(priority) else int(priority)


def work(leases: DataFrame, handlers: dict[str, Callable[[dict], None]]) -> DataFrame:
    """Reports (INPUT) of leased tasks: each runs on an executor, those of a partition by priority."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for task in batch.to_dict("records"):
                try:
                    handlers[task["type"]](task)
                    status, error = "completed", None
                except Exception as e:  # noqa: BLE001  a task must not end the worker
                    status, error = "failed", f"{type(e).__name__}: {e}"
                out.append((task["key"], task["type"], task["payload"], _number(task["priority"]), status, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in INPUT.split(", ")])

    rows = leases.where("kind = 'lease'").select("key", "type", "payload", "priority", "attempt")
    return rows.repartition("key").sortWithinPartitions(F.desc("priority"), "key").mapInPandas(run, INPUT)


def start_queue(tasks: DataFrame, folder: str, lease_ms: int = 60_000, most_attempts: int = 5, trigger: str = "1 second") -> StreamingQuery:
    """The stream that leases the tasks of a stream (INPUT) below a shared folder: it reads ``reports`` and writes ``leases`` there."""
    spark = tasks.sparkSession
    reports = f"{folder}/reports"
    path = spark._jvm.org.apache.hadoop.fs.Path(reports)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = tasks.unionByName(spark.readStream.schema(INPUT).parquet(reports))
    writer = lease(rows, lease_ms, most_attempts).writeStream.format("parquet").option("path", f"{folder}/leases").option("checkpointLocation", f"{folder}/queue-state")
    return writer.outputMode("append").trigger(processingTime=trigger).start()


def start_worker(spark, folder: str, handlers: dict[str, Callable[[dict], None]], name: str, trigger: str = "1 second") -> StreamingQuery:
    """A worker over the leases of a queue. Each has a name, which is its place in the leases; a new name starts at their begin."""
    leases = spark.readStream.schema(OUTPUT).parquet(f"{folder}/leases")

    def run(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its reports
        work(batch, handlers).write.mode("overwrite").parquet(f"{folder}/reports-of/{name}/{number}")
        spark.read.schema(INPUT).parquet(f"{folder}/reports-of/{name}/{number}").write.mode("append").parquet(f"{folder}/reports")

    return leases.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/worker-{name}").trigger(processingTime=trigger).start()


def ended(spark, folder: str) -> DataFrame:
    """(key, type, payload, priority, attempt, status, error) of all tasks that have ended, each once."""
    return spark.read.schema(OUTPUT).parquet(f"{folder}/leases").where("kind = 'done'").drop("kind")
