"""The leased task queue: a thousand tasks, a worker that dies, each task reported once."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import leases as L


@pytest.fixture(autouse=True)
def timers(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def until(test, seconds=150):
    stop = time.time() + seconds
    while time.time() < stop:
        try:
            if test():
                return True
        except Exception:  # noqa: BLE001  the folder may not be there yet
            pass
        time.sleep(0.5)
    return False


def ok(task):
    if int(task["payload"]) % 100 == 7:
        raise ValueError("no")


def test_killed_worker(spark, tmp_path):
    """The first worker dies with its leases, which another one gets when their time is over."""
    folder = f"file://{tmp_path}/q"
    rows = spark.range(1000).select(F.format_string("t%04d", "id").alias("dedup_key"), F.lit("add").alias("type"), F.col("id").cast("string").alias("payload"), (F.col("id") % 5).cast("int").alias("priority"))
    put = lambda part: L.as_input(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(rows.where("id < 600"))
    tasks = spark.readStream.schema(L.INPUT).parquet(f"{tmp_path}/in")

    def dies(task):
        os._exit(1)

    queue = L.start_queue(tasks, folder, lease_ms=4000, trigger="500 milliseconds")
    try:
        leased = lambda: spark.read.schema(L.OUTPUT).parquet(f"{folder}/leases").where("kind = 'lease'")
        assert until(lambda: leased().count() >= 600)
        first = L.start_worker(spark, folder, {"add": dies}, "first")
        with pytest.raises(Exception):
            first.awaitTermination(60)
        # its leases come up again, and so do new tasks; some come twice
        put(rows.where("id >= 500"))
        assert until(lambda: leased().where("attempt > 1").count() >= 600)
        second = L.start_worker(spark, folder, {"add": ok}, "second", "500 milliseconds")
        try:
            assert until(lambda: L.ended(spark, folder).count() >= 1000)
            time.sleep(3)
        finally:
            second.stop()
    finally:
        queue.stop()
    done = L.ended(spark, folder).toPandas()
    assert len(done) == done["key"].nunique() == 1000
    failed = done[done["status"] == "failed"]
    assert sorted(failed["payload"].astype(int)) == list(range(7, 1000, 100)) and set(failed["error"]) == {"ValueError: no"}
    assert (done.loc[done["status"] != "failed", "status"] == "completed").all() and done["attempt"].max() > 1


def test_attempts_end(spark, tmp_path):
    """A task that no worker reports ends as failed after its last lease."""
    folder = f"file://{tmp_path}/q"
    L.as_input(spark.createDataFrame([("a", "x", "1", None)], "dedup_key string, type string, payload string, priority int")).write.parquet(f"{tmp_path}/in")
    queue = L.start_queue(spark.readStream.schema(L.INPUT).parquet(f"{tmp_path}/in"), folder, lease_ms=500, most_attempts=3, trigger="300 milliseconds")
    try:
        assert until(lambda: L.ended(spark, folder).count() == 1)
    finally:
        queue.stop()
    row = L.ended(spark, folder).first()
    assert (row["status"], row["attempt"], row["error"]) == ("failed", 3, "no report of 3 leases")
