import datetime as dt
import time

from pyspark.sql import functions as F

from lodestone.streaming import queue, status, windows

T0 = dt.datetime(2024, 1, 1)


def tasks(spark, *rows):
    return spark.createDataFrame([(k, t, f'{{"repository_id": {r}}}', p, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m)) for k, t, r, p, m in rows], "dedup_key string, type string, payload string, priority int, created_at timestamp, updated_at timestamp")


def test_queue(spark):
    q = tasks(spark, ("a", "x", 1, 1000, 0), ("b", "y", 2, 2000, 1), ("c", "x", 1, 2000, 0))
    head, rest = queue.dequeue(q)
    assert head.first()["dedup_key"] == "c" and rest.count() == 2
    assert queue.dequeue(q, "y")[0].first()["dedup_key"] == "b"
    merged = queue.enqueue(q, tasks(spark, ("a", "x", 1, 9000, 5), ("d", "x", 3, 1, 5)))
    assert merged.count() == 4 and merged.where("dedup_key = 'a'").first()["priority"] == 9000
    assert queue.drain(q, 1).count() == 1 and queue.page(q, "x", 2, 0).count() == 1
    assert queue.reprioritise(q, "a", 7).where("priority = 7").count() == 1
    repos = spark.createDataFrame([(1, None), (2, T0), (3, T0 + dt.timedelta(hours=5))], "id int, last_scanned_at timestamp")
    assert sorted(r["id"] for r in queue.due(repos, T0 + dt.timedelta(hours=5)).collect()) == [1, 2]


def test_worker(spark, tmp_path):
    tasks(spark, ("a", "ok", 1, 1, 0), ("b", "bad", 1, 9, 0)).write.parquet(f"{tmp_path}/in")
    done = []
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    worker = queue.run_worker(stream, {"ok": lambda t: None}, lambda t, s, e: done.append((t["dedup_key"], s)), f"{tmp_path}/cp")
    worker.awaitTermination(60)
    assert done == [("b", "failed"), ("a", "completed")]


def test_windows_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=7 * k), k % 3) for k in range(200)], "event_id long, ts timestamp, user_id long")
    events.write.parquet(f"{tmp_path}/e")
    count = {"n": F.count("*")}
    batch = sorted(map(tuple, windows.tumbling(events, "ts", "1 hour", ["user_id"], count).collect()))
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windows.tumbling(stream, "ts", "1 hour", ["user_id"], count).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == batch
    assert windows.sessions(events, "ts", "30 minutes", ["user_id"], count).count() == 3
    assert windows.deduplicated(events.union(events), "ts", ["event_id"]).count() == 200
    assert windows.sliding(events, "ts", "2 hours", "1 hour", [], count).agg(F.sum("n")).first()[0] == 400


def test_state_machine(spark):
    assert status.advance(None, "start") == "started" and status.advance("started", "progress") == "in_progress" and status.advance("failed", "complete") == "failed"
    rows = spark.createDataFrame([("started", None), ("completed", None)], "state string, error string")
    assert sorted(r["state"] for r in status.recover_stale(rows).collect()) == ["completed", "failed"]


def test_throttle(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id string, state string, payload string"
    folder = f"{tmp_path}/u"

    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    seen = lambda: sorted(map(tuple, spark.table("throttled").collect()))

    def wait(n):
        # with timers a query runs batches without data for ever, so it never reports that it is done
        end = time.time() + 40
        while len(seen()) < n and time.time() < end:
            time.sleep(0.5)

    add(("a", "in_progress", "1"), ("b", "in_progress", "1"))
    out = status.throttle(spark.readStream.schema(schema).parquet(folder), 3_600_000)
    q = out.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        wait(2)
        add(("a", "in_progress", "2"), ("b", "completed", "2"))
        wait(3)
        got = seen()
    finally:
        q.stop()
    assert got == [("a", "in_progress", "1"), ("b", "completed", "2"), ("b", "in_progress", "1")]


def test_throttle_timer(spark, tmp_path):
    """What is held back comes out when the interval is over, the last update of it alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id string, state string, payload string"
    spark.createDataFrame([("a", "in_progress", str(k)) for k in range(1, 5)], schema).coalesce(1).write.parquet(f"{tmp_path}/u")
    out = status.throttle(spark.readStream.schema(schema).parquet(f"{tmp_path}/u"), 2000)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        end, got = time.time() + 90, []
        while len(got) < 2 and time.time() < end:
            time.sleep(0.5)
            got = sorted(r["payload"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == ["1", "4"]
