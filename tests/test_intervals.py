"""Interval joins and event time with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def ranges(rng, n, longest):
    out = []
    for k in range(n):
        start = rng.randrange(-500, 3000)
        out.append((rng.choice(["a", "b", None]), start, start + rng.choice([0, 1, rng.randrange(longest)]), k))
    return [*out, ("a", 5, 4, n), ("a", None, 4, n + 1), ("b", 7, None, n + 2), ("a", -(10**9), 10**9, n + 3), ("a", 15, 16, n + 4), ("a", 16, 16, n + 5)]


@pytest.mark.parametrize(("width", "many"), [(16, 100_000), (1, 3), (4, 20)])
def test_interval_join(spark, width, many):
    rng = random.Random(width)
    left, right = ranges(rng, 150, 40), ranges(rng, 120, 1500)
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] and x[0] == y[0] and None not in (*x[1:3], *y[1:3]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    a = spark.createDataFrame(left, "k string, low long, high long, n int")
    b = spark.createDataFrame(right, "k string, from long, upto long, m int")
    got = R.interval_join(a, b, ["k"], "low", "high", "from", "upto", width, many)
    assert got.columns == ["k", "low", "high", "n", "from", "upto", "m"]
    assert sorted((r["n"], r["m"]) for r in got.collect()) == want and len(want) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert R.interval_join(a.limit(0), b, ["k"], "low", "high", "from", "upto").count() == 0


def test_crowded_bin(spark):
    """A third of all rows in one bin: dealt into parts, and each pair found once."""
    a = spark.range(900).select(F.lit("x").alias("k"), F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("low"), "id").withColumn("high", F.col("low"))
    b = spark.createDataFrame([("x", 0, 10, "in"), ("x", 890, 2000, "end"), ("y", 0, 9, "no")], "k string, from long, upto long, name string")
    got = {r["name"]: r["count"] for r in R.interval_join(a, b, ["k"], "low", "high", "from", "upto", many=50).groupBy("name").count().collect()}
    assert got == {"in": 300, "end": 10}


def test_late_rows(spark, tmp_path):
    """Closed windows are final: what comes for them later is left out, what comes for open ones counts."""
    batches = [[(1, 10), (2, 70), (3, 400)], [(4, 20), (5, 405)], [(6, 15), (7, 330), (8, 1000)]]
    for rows in batches:
        spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in rows], "k long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    rows = windows.tumbling(stream, "ts", "1 hour", [], {"n": F.count("*")}).select(F.hour("start").alias("hour"), "n")
    rows.writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect())) and None).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    # row 6 is late (its hour ended before 400 - 60 minutes), row 7 is not
    assert sorted(got) == [(0, 2), (1, 1), (5, 1), (6, 2)]
