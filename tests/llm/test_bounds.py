"""Bounds that must hold where ids, rows or groups repeat very often."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, sharding, toxicity
from lodestone.llm.common import _parts, join_partners, labelled_sample, within_bytes

from .conftest import rows_of
from .test_plain import shards_are_right


def test_sample_of_repeated_ids(spark):
    """One text an id, the same one however rows are dealt, and never more rows than the limit."""
    rows = [(7, f"text {k}", "en", "a") for k in range(3000)] + [(k, f"other {k}" * (k % 5), "en", "a") for k in range(100, 160)] + [(200, None, "en", "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in [7, *range(100, 160), 200]] + [(7, 0), (None, 1), (101, None)], "doc_id long, toxic int")
    got = [sorted(map(tuple, labelled_sample(rows_of(spark, rows).repartition(n), labels, "toxic", F.lit(True), 20).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len({i for i, _, _ in got[0]}) == 20
    every = {i: (t, y) for i, t, y in labelled_sample(rows_of(spark, rows), labels, "toxic", F.lit(True), 1000).collect()}
    assert len(every) == 62 and every[200] == ("", 0) and every[7][1] == 1 and every[7][0] in {t for i, t, _, _ in rows if i == 7}


def test_sample_within_bytes(spark):
    sample = spark.createDataFrame([(k, "x" * 10 * k, k % 2) for k in range(30)], "doc_id long, text string, y int")
    assert within_bytes(sample, 10**6).count() == 30
    some = within_bytes(sample, 1000).collect()
    assert 0 < len(some) < 30 and sum(len(r["text"]) for r in some) <= 1000
    assert within_bytes(sample.where("doc_id > 20"), 5).count() == 1


def test_training_is_bounded(spark, monkeypatch):
    """What reaches the driver for training has at most ``max_bytes``."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((sum(map(len, texts)), len(y))))
    docs = rows_of(spark, [(k % 50, "word " * (k % 40), "en", "a") for k in range(400)])
    toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int"), max_bytes=500)
    assert 0 < seen[0][0] <= 500


def test_shards_of_equal_rows(spark, monkeypatch):
    """Most rows are equal: their chunk is dealt further, and slots have no gap."""
    parts = []

    class Noted(common.Scratch):
        def __call__(self, df, what):
            out = super().__call__(df, what)
            if what == "shard-offsets":
                parts.extend(map(tuple, out.select("shard", "first").collect()))
            return out

    monkeypatch.setattr(sharding, "Scratch", Noted)
    rows = [(3, "the same row")] * 4000 + [(k, f"text {k}") for k in range(400)]
    got = sharding.shard_documents(rows_of(spark, [(i, t, "en", "a") for i, t in rows]).repartition(6), rows_per_chunk=60).collect()
    shards_are_right(got, rows)
    ends = {s: sum(r["shard"] == s for r in got) for s in {s for s, _ in parts}}
    firsts = {s: sorted([f for t, f in parts if t == s] + [ends[s]]) for s in ends}
    assert max(b - a for f in firsts.values() for a, b in zip(f, f[1:], strict=False)) <= 200


def test_parts_follow_sizes(spark):
    sizes = lambda *n: spark.createDataFrame([(k,) for k in n], "_n long")
    assert _parts(sizes(10, 20), 1000) == (1000, 1) and _parts(sizes(5000, 20), 1000) == (1000, 5) and _parts(sizes(), 50) == (50, 1)
    large, parts = _parts(sizes(10**9, *[10**6] * 2000), 1000)
    assert parts <= common.LISTED and large >= 3 * 10**9 // common.LISTED


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_partners(spark, how):
    pairs = [(k, 0) for k in range(1, 3000)] + [(k, 5000 + k % 7) for k in range(50)] + [(1, 9999)]
    known = [(0, "hub"), *((5000 + k, f"n{k}") for k in range(7))]
    got = join_partners(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(known, "b long, name string"), "b", "a", common.Scratch(), how)
    names = dict(known)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, b, names.get(b))) for a, b in pairs if how == "left" or b in names)
