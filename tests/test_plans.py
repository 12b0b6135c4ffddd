import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import mutations as M
from lodestone.operators import options as O
from lodestone.operators import relational as R
from lodestone.plans import dag, ingest, retrieval
from lodestone.plans.keyword import KeywordIndex
from lodestone.plans.vector_index import VectorIndex
from lodestone.schemas import TABLES, validate_schema


def lists(spark, *named):
    rows = [(n, i, float(-r), r) for n, ids in enumerate(named) for r, i in enumerate(ids)]
    return spark.createDataFrame(rows, "list_id int, id string, score double, rank int")


def test_fusion(spark):
    got = {r["id"]: r["score"] for r in retrieval.fuse(lists(spark, "abc")).collect()}
    assert got == pytest.approx({"a": 1 / 60, "b": 1 / 61, "c": 1 / 62})
    two = retrieval.fuse(lists(spark, "ab", "bc")).collect()
    assert [r["id"] for r in two] == ["b", "a", "c"] and two[0]["score"] == pytest.approx(1 / 61 + 1 / 60)
    assert [r["id"] for r in retrieval.fuse(lists(spark, "abc"), k=2).collect()] == ["a", "b"]
    assert retrieval.fuse(lists(spark, "a"), constant=10).first()["score"] == pytest.approx(0.1)
    assert retrieval.fuse(lists(spark, "a"), constant=-5).first()["score"] == pytest.approx(1 / 60)
    assert [r["id"] for r in retrieval.fuse(lists(spark, "c", "a", "b")).collect()] == ["a", "b", "c"]


def test_topk(spark):
    v = spark.createDataFrame([("exact", [1.0, 0.0, 0.0]), ("similar", [0.9, 0.1, 0.0]), ("orthogonal", [0.0, 1.0, 0.0]), ("opposite", [-1.0, 0.0, 0.0])], "id string, embedding array<double>")
    ids = lambda *a, **k: [r["id"] for r in retrieval.exact_topk(v, [1.0, 0.0, 0.0], *a, **k).collect()]
    assert ids(2) == ["exact", "similar"] and len(ids(10)) == 4 and ids(0) == []
    assert ids(10, allowed=spark.createDataFrame([("similar",), ("orthogonal",)], "id string")) == ["similar", "orthogonal"]
    assert ids(10, allowed=spark.createDataFrame([], "id string")) == []


def test_probes():
    assert [retrieval.probe_count(n)[1] for n in (0, 1, 10, 100, 1000, 10_000, 100_000, 1_000_000)] == [10, 10, 10, 10, 10, 31, 100, 316]


def test_ivf_recall(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1000)] + 0.2 * rng.normal(size=(1000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    assert not index.exists
    index.build(v.where("id < 900")).add(v.where("id >= 900"))
    assert 80 <= index.lists() <= 90 and index.count() == 1000
    hits = 0
    for q in range(5):
        want = {r["id"] for r in retrieval.exact_topk(v, x[q].tolist(), 10).collect()}
        hits += len(want & {r["id"] for r in index.find(x[q].tolist(), 0).collect()})
    assert hits >= 45
    plan = index.find(x[0].tolist(), 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters", 1)[1][:200] and "list_id" in plan.split("PushedFilters", 1)[1][:200]


def test_batch_topk_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)], "id long, embedding array<double>")
    queries = v.where("id < 23").withColumnRenamed("id", "query_id")
    rows = lambda most: sorted((r["query_id"], r["rank"], r["id"]) for r in retrieval.batch_topk(v, queries, 4, most=most).collect())
    assert rows(4096) == rows(5) and len(rows(5)) == 92 and retrieval.batch_topk(v, queries.limit(0), 4).count() == 0
    assert retrieval.batch_topk(v, queries.limit(1), 0).count() == 10


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "the running dogs run"), (2, "a dog runs home"), (3, "nothing here"), (4, None)], "id long, text string")
    index = retrieval.postings(docs, analyzer="porter")
    assert {r["id"] for r in retrieval.bm25_terms(index, ["dog"]).collect()} == {1, 2}
    # both hold the phrase once and are of equal length, so the id decides
    assert [r["id"] for r in retrieval.bm25_phrase(index, ["dog", "run"]).collect()] == [1, 2]
    assert [r["id"] for r in retrieval.bm25_phrase(index, ["run", "dog", "run"]).collect()] == [1]
    assert retrieval.bm25_phrase(index, []).count() == 0


def bm25_plain(docs, terms, analyze, k1=1.2, b=0.75):
    """Robertson and Zaragoza's score, from the texts alone."""
    lists = {i: analyze(t or "") for i, t in docs.items()}
    lists = {i: ts for i, ts in lists.items() if ts}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    out = {}
    for term in set(terms):
        df = sum(term in ts for ts in lists.values())
        for i, ts in lists.items():
            if tf := ts.count(term):
                out[i] = out.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / mean))
    return out


@pytest.mark.parametrize("analyzer", ["words", "porter", "bag"])
def test_keyword_index(spark, tmp_path, analyzer):
    """A stored index finds what a plain one does, skips what it knows, and forgets what is removed."""
    rng = random.Random(4)
    words = ["running", "runs", "dogs", "dog", "nation", "nations", "the", "of", "Café", "x1", "worthless"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for i in range(60)} | {60: " ", 61: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = KeywordIndex(spark, f"file://{tmp_path}/k", analyzer, slots=5)
    assert not index.exists and index.add(df.where("id < 40")) == 40 and index.add(df) == 20 and index.add(df) == 0
    analyze = retrieval.ANALYZERS[analyzer]

    def check(known, allowed=None):
        want = bm25_plain({i: texts[i] for i in known}, analyze("dogs of nations"), analyze)
        best = sorted(want.items(), key=lambda x: (-x[1], str(x[0])))
        got = [(int(r["id"]), r["score"]) for r in index.find("dogs of nations", 7, allowed, phrase=False).collect()]
        best = [x for x in best if allowed is None or x[0] % 2 == 0][:7]
        assert [i for i, _ in got] == [i for i, _ in best] and [s for _, s in got] == pytest.approx([s for _, s in best])

    check(range(60))
    check(range(60), df.where("id % 2 = 0").select("id"))
    assert index.find("dogs", allowed=df.limit(0).select("id")).count() == 0
    assert sorted(r["id"] for r in index.lookup(["3", "60", "77"]).collect()) == ["3"] and index.lookup(["3"]).first()["score"] == 0.0
    index.remove(df.where("id < 10").select("id"))
    check(range(10, 60))
    again = KeywordIndex(spark, f"file://{tmp_path}/k", analyzer, slots=99)
    assert again.slots == 5 and again.lookup(["3"]).count() == 0 and again.add(df) == 10
    plan = index.postings(["dog"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "EqualTo(term,dog)" in plan


def test_grep(spark):
    files = spark.createDataFrame([("a.go", "func a()\nx"), ("b.go", "y\nfunc b()"), ("c.py", "def c()")], "path string, content string")
    assert retrieval.matching_lines(files, "func").count() == 2
    assert retrieval.matching_lines(files, r"func.*\(\)", "*.go").count() == 2 and retrieval.matching_lines(files, "none").count() == 0
    assert [r["path"] for r in retrieval.grep(files, "func").collect()] == ["a.go", "b.go"]
    with pytest.raises(ValueError):
        retrieval.check_pattern("x", "../y")


def test_scope_fails_closed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "repo long, lang string")
    f = O.Filters(source_repos=(2, 3)).scoped([1, 2])
    assert f.source_repos == (2,) and [r["repo"] for r in rows.where(f.predicate({"source_repos": "repo"})).collect()] == [2]
    assert rows.where(O.Filters(source_repos=(3,)).scoped([1]).predicate({"source_repos": "repo"})).count() == 0
    assert O.Filters().is_empty() and not O.Filters(languages=("a",)).is_empty()


def test_options(spark):
    rows = spark.range(50).withColumn("even", F.col("id") % 2 == 0)
    assert [r["id"] for r in O.build(O.with_condition("even", True), O.with_pagination(2, 3)).apply(rows, key="id").collect()] == [6, 8]
    assert O.build(O.with_condition_in("id", range(2000))).apply(rows).count() == 50
    assert O.build(O.with_condition_in("id", [])).apply(rows).count() == 0
    assert [r["id"] for r in O.Query().where("id", "<", 9).order_by("id", True).paginate(0, 0).apply(rows).collect()] == list(range(8, -1, -1))
    assert O.parse_pagination(None, "500") == (1, 100)
    with pytest.raises(ValueError):
        O.parse_pagination("0", None)


def test_rollup(spark):
    t = dt.datetime(2024, 1, 1)

    def status(states, queued=0):
        rows = spark.createDataFrame([(1, s, t + dt.timedelta(minutes=k), f"e{k}") for k, s in enumerate(states)], "id int, state string, updated_at timestamp, error string")
        pending = spark.createDataFrame([(1,)] * queued, "id int")
        got = R.status_rollup(rows, ["id"], pending).collect()
        return (got[0]["status"], got[0]["message"]) if got else ("pending", None)

    assert status([]) == ("pending", None) and status([], 1) == ("in_progress", None)
    assert status(["completed"] * 2) == ("completed", None) and status(["failed", "started"]) == ("in_progress", None) and status(["failed"], 1) == ("in_progress", None)
    assert status(["completed"] * 3 + ["failed"]) == ("completed_with_errors", "e3")
    assert status(["completed", "failed", "failed", "failed"]) == ("failed", "e3") and status(["completed", "failed"]) == ("failed", "e1")


def test_store(spark, tmp_path):
    store = M.TableStore(spark, f"file://{tmp_path}")
    assert not store.exists("t")
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    store.write("t", M.upsert(store.read("t"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]))
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.transaction({"t": M.delete_where(store.read("t"), F.col("id") == 1), "u": store.read("t")})
    assert store.read("t").count() == 2 and store.read("u").count() == 3
    store.vacuum(["t"])
    assert store.read("t").count() == 2
    with pytest.raises(ValueError):
        M.delete_where(store.read("t"), None)
    part = M.upsert(store.read("u"), spark.createDataFrame([(1, "z")], "id int, v string"), ["id"], update=["v"])
    assert sorted(map(tuple, part.collect()))[0] == (1, "z")


def test_dag():
    assert dag.topological(["a", "b", "c"], {"a": ["c"], "c": ["b"]}) == ["b", "c", "a"]
    with pytest.raises(ValueError):
        dag.topological(["a", "b"], {"a": ["b"], "b": ["a"]})
    book = dag.PipelineBook()
    book.initialise()
    assert dag.operations(book.pipelines["default"])[0] == "commit.scan"
    with pytest.raises(ValueError):
        book.create(dag.Pipeline("x", (dag.Step("a", "k", ("missing",)),)))
    book.create(dag.Pipeline("x", (dag.Step("own", "k"), dag.Step("scan", "k"))))
    assert book.delete("x") == {"own"}
    assert dag.choose_commit({"main": "1", "dev": "2"}, ["9"], ("branch", "dev"), "main") == "2"
    assert dag.choose_commit({"main": "1"}, ["9"], ("commit", "9"), "main") == "9" and dag.choose_commit({"main": "1"}, [], ("tag", "v1"), "main") == "1" and dag.choose_commit({}, [], None, None) is None
    assert dag.default_branch(["x", "master"]) == "master"


def test_ingest(spark):
    files = spark.createDataFrame([(5, "one two\n" * 40, 1, "c0", "src/a.py"), (0, None, 1, "c0", "b.go")], "id long, content string, repo_id long, commit_sha string, path string")
    found = ingest.chunk_files(files, ingest.ChunkConfig(100, 20, 10)).cache()
    tables = ingest.chunk_tables(found, files)
    n = found.count()
    assert n >= 4 and tables["enrichments_v2"].select("id").distinct().count() == n and tables["enrichment_associations"].count() == 3 * n
    assert tables["enrichments_v2"].first()["language"] == "py"
    pages = spark.createDataFrame([(1, 1, "äb"), (1, 2, "c"), (1, 3, None)], "k int, page int, text string")
    row = ingest.pages_text(pages, "k").first()
    assert row["content"] == "äb\nc\n" and [tuple(b) for b in row["boundaries"]] == [(1, 0), (2, 4), (3, 6)]


def test_embedding_pipeline(spark):
    rows = spark.createDataFrame([("1", "a b"), ("2", "bad"), ("3", " "), ("4", "c")], "snippet_id string, text string")
    index = spark.createDataFrame([("4",)], "snippet_id string")
    base = ingest.hash_embedder(8)

    def model(items):
        if "bad" in items:
            raise RuntimeError("no")
        return base(items)

    got = {r["snippet_id"]: r for r in ingest.index_new(rows, index, model, most_rows=1).collect()}
    assert set(got) == {"1", "2"} and got["1"]["error"] is None and "no" in got["2"]["error"] and got["2"]["embedding"] is None
    with pytest.raises(RuntimeError):
        ingest.check_failures(ingest.index_new(rows, index, model, most_rows=1))
    answers = ingest.generate(spark.createDataFrame([("1", "s", "t")], "id string, system string, text string"), lambda s, t: s + t).first()
    assert answers["answer"] == "st"


def test_anti_join_beyond_a_thousand(spark):
    assert R.new_only(spark.range(3000), spark.range(2500), "id").count() == 500


def test_schemas(spark):
    df = spark.createDataFrame([], TABLES["git_tags"])
    assert validate_schema(df, "git_tags") == [] and validate_schema(df.drop("name"), "git_tags") == ["git_tags.name"]
