"""Bags of words by block bounds: the same results as reading every posting, from few of them."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lodestone.plans import keyword as K
from lodestone.plans import retrieval


def full(index, terms, k, allowed=None):
    return [(r["id"], round(r["score"], 9)) for r in retrieval.bm25_terms(index.postings(terms), terms, k, stats=index.stats(), allowed=allowed).collect()]


def best(index, terms, k, allowed=None):
    return [(r["id"], round(r["score"], 9)) for r in index.best(terms, k, allowed).collect()]


def docs_of(spark, n, seed, first=0):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{k}" for k in range(30))]
    weights = [40, 20, *(1 + 30 // (k + 1) for k in range(30))]
    rows = [(str(first + k), " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 20, 60, 200])))) for k in range(n)]
    return spark.createDataFrame(rows, "id string, text string")


def test_every_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_DOCS", 4)
    monkeypatch.setattr(K, "FIRST_BLOCKS", 3)
    index = K.KeywordIndex(spark, f"file://{tmp_path}", "words").build(docs_of(spark, 600, 1))
    terms = ["the", "of", "w0", "w3", "w25", "none"]
    for pair in [*combinations(terms, 2), ("the",), ("w25",), ("none",), ("the", "the", "w9", "w8", "w29")]:
        assert best(index, list(pair), 10) == full(index, list(pair), 10), pair
    allowed = spark.createDataFrame([(str(k),) for k in range(0, 600, 7)], "id string")
    assert best(index, ["the", "w3"], 10, allowed) == full(index, ["the", "w3"], 10, allowed) and best(index, ["the"], 5, allowed.limit(0)) == []
    assert len(best(index, ["the"], 1000)) == len(full(index, ["the"], 1000)) > 300 and index.best([], 3).count() == 0
    monkeypatch.setattr(K, "MOST_RANGES", 2)
    assert best(index, ["of", "w3"], 10) == full(index, ["of", "w3"], 10)

    # documents that are added, and removed, change frequencies, and with them every score
    before = index.slots
    assert index.add(docs_of(spark, 700, 2, first=300)) == 400
    assert best(index, ["the", "w3"], 10) == full(index, ["the", "w3"], 10) and index._config(index.store.begin())["built"] == 600
    index.remove(spark.createDataFrame([(i,) for i, _ in best(index, ["the"], 10)], "id string"))
    assert best(index, ["the", "w3"], 10) == full(index, ["the", "w3"], 10)
    assert index.compact() and not index.store.state()["tables"]["postings"]["gone"]
    assert best(index, ["the", "w3"], 10) == full(index, ["the", "w3"], 10)
    # an index that has outgrown its layout gets another one
    assert index.add(docs_of(spark, 2500, 3, first=5000)) == 2500
    config = index._config(index.store.begin())
    assert config["built"] == 3490 and config["spread"] > 100 and config["slots"] >= before
    assert best(index, ["the", "w3"], 10) == full(index, ["the", "w3"], 10)


def test_few_postings_are_read(spark, monkeypatch):
    """A tenth of a very frequent word's postings at most, on the medium table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index = K.shared_index(docs, "doc_id", "text", "words")
    read, known = [], retrieval.bm25_known
    monkeypatch.setattr(retrieval, "bm25_known", lambda rows, *a: read.append(rows.count()) or known(rows, *a))
    often = index.postings(["the"]).count()
    got = best(index, ["the"], 10)
    assert got == full(index, ["the"], 10) and 0 < sum(read) < 0.1 * often and often > 3000
    plan = index.best(["the"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "GreaterThanOrEqual(block" in plan or "block" in plan.split("PushedFilters")[1][:300]


def test_layout_grows():
    assert K.layout(10, 1000) == (8, 1) and K.layout(10**6, 4 * 10**8)[0] == 512 and K.layout(10**6, 1)[1] == 10**6 // 256
    slots, spread = K.layout(10**10, 4 * 10**12)
    assert slots >= 2**21 and spread > 10**7


def test_ranges(spark):
    rows = spark.range(0, 40).select(F.col("id").cast("int").alias("block"))
    for chosen in ([], [3], [5, 4, 6, 20], list(range(40)), [0, 39]):
        assert sorted(r["block"] for r in rows.where(K.in_blocks(chosen)).collect()) == sorted(chosen)


def test_postings_are_packed(spark, tmp_path, monkeypatch):
    """A row holds all postings that a block has of a term; an index takes little more room than its texts, and texts are not shuffled."""
    docs = docs_of(spark, 400, 5).coalesce(1)
    index = K.KeywordIndex(spark, f"file://{tmp_path}", "words").build(docs)
    rows, want = index.store.read("postings", K._POSTINGS), sorted(map(str, retrieval.postings(docs).selectExpr("term", "id", "dl", "tf", "positions").collect()))
    assert rows.agg(F.sum("n")).first()[0] == len(want) > 5 * rows.count()
    terms = [r["term"] for r in rows.select("term").distinct().collect()]
    assert sorted(map(str, index.postings(terms).collect())) == want
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3 * size
    # cut into small parts, laid out anew and compacted, the postings are the same
    monkeypatch.setattr(K, "PACKED_TERMS", 50)
    monkeypatch.setattr(K, "BLOCK_DOCS", 3)
    small = K.KeywordIndex(spark, f"file://{tmp_path}/small", "words").build(docs.where("cast(id AS int) < 40"))
    assert small.add(docs) == 360 and small._config(small.store.begin())["built"] == 400
    assert sorted(map(str, small.postings(terms).collect())) == want
    gone = docs.where("cast(id AS int) % 3 = 0").select("id")
    small.remove(gone)
    left = sorted(map(str, retrieval.postings(docs.join(gone, "id", "left_anti")).selectExpr("term", "id", "dl", "tf", "positions").collect()))
    assert sorted(map(str, small.postings(terms).collect())) == left
    assert small.compact() and sorted(map(str, small.postings(terms).collect())) == left
    assert sorted(map(str, small.unpacked(small.store.read("postings", K._POSTINGS)).select("term", "id", "dl", "tf", "positions").collect())) == left


def test_repeated_ids(spark, tmp_path):
    """Of rows with one id one is indexed, and its terms and its length are of the same text."""
    docs = spark.createDataFrame([("1", "a b"), ("1", "a b c"), ("2", "a"), ("2", " "), ("3", "--")], "id string, text string")
    index = K.KeywordIndex(spark, f"file://{tmp_path}", "words").build(docs)
    known = {r["id"]: r["dl"] for r in index.store.read("docs").collect()}
    assert sorted(known) == ["1", "2", "3"] and known["2"] == 1 and known["3"] == 0
    assert {(r["id"], r["dl"]) for r in index.postings(["a"]).collect()} == {("1", known["1"]), ("2", 1)} and index.stats().first()["n"] == 2
