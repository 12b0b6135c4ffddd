"""Sketches by file, and exact percentiles without a group in one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.operators.sketches import SketchTable
from lodestone.operators.tables import TableStore


def test_refresh_reads_new_files(spark, tmp_path):
    folder, rng = f"file://{tmp_path}/rows", random.Random(1)
    values = [("a" if k % 3 else None, rng.gauss(0, 10), k % 500) for k in range(6000)]
    table = SketchTable(TableStore(spark, f"file://{tmp_path}/store"), "s", ["g"], "v", "u")
    add = lambda rows: spark.createDataFrame(rows, "g string, v double, u long").coalesce(1).write.mode("append").parquet(folder)
    read = []
    for part in (values[:2000], values[2000:5000], values[5000:]):
        add(part)
        read.append(table.refresh(spark.read.parquet(folder)))
        read.append(table.refresh(spark.read.parquet(folder)))
    assert read == [1, 0, 1, 0, 1, 0]
    got = {r["g"]: r for r in table.quantiles([0.1, 0.5, 0.99]).collect()}
    assert set(got) == {"a", None}
    for g, r in got.items():
        mine = sorted(v for h, v, _ in values if h == g)
        assert r["n"] == len(mine) and abs(r["distinct"] - len({u for h, _, u in values if h == g})) <= 15
        for q, p in (("q0", 0.1), ("q1", 0.5), ("q2", 0.99)):
            assert abs(sum(v <= r[q] for v in mine) / len(mine) - p) <= 0.01
    # a file that is gone makes all others count anew
    next(p for p in (tmp_path / "rows").iterdir() if p.suffix == ".parquet").unlink()
    assert table.refresh(spark.read.parquet(folder)) == 2 and table.merged().agg(F.sum("n")).first()[0] < 6000


@pytest.mark.parametrize("n", [1, 20, 997])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(30)), rng.random()])) for _ in range(n)] + [("c", None), ("d", 4.0)]
    got = {r["k"]: tuple(r)[1:] for r in R.exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", {"none": "0", "half": "0.5", "most": "0.95", "all": "1"}).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        mine = sorted(v for j, v in rows if j == k and v is not None)
        want[k] = tuple(mine[max(math.ceil(len(mine) * p / 100), 1) - 1] for p in (0, 50, 95, 100))
    assert got == want
