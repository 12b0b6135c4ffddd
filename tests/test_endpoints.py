import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators.options import Filters
from lodestone.plans import endpoints as N
from lodestone.schemas import TABLES

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    def table(name, *rows):
        names = TABLES[name].fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[name]).cache()

    commits = [dict(commit_sha=s, repo_id=r, date=T + dt.timedelta(days=d), author=a) for s, r, d, a in (("c1", 1, 0, "ann"), ("c2", 1, 5, "bob"), ("d1", 2, 1, "ann"))]
    texts = [(1, "c1", "chunk", "old code", "py"), (2, "c2", "chunk", "the dog runs", "py"), (3, "c2", "chunk", "a cat sleeps", "go"), (4, "d1", "chunk", "dogs running", "py"), (5, "c2", "summary", "about dogs", ""), (6, "c2", "wiki", '{"pages": [{"slug": "a", "title": "A", "content": "see [b](b)", "children": [{"slug": "b", "title": "B"}]}]}', "")]
    edges = [(i, "git_commits", s) for i, s, *_ in texts] + [(2, "git_commits", "c1"), (2, "git_commit_files", "20"), (3, "git_commit_files", "30"), (4, "git_commit_files", "40"), (5, "enrichments_v2", "2"), (3, "git_commit_files", "x")]
    return N.Catalog({
        "git_repos": table("git_repos", dict(id=1, sanitized_remote_uri="https://h/a", upstream_url=None), dict(id=2, sanitized_remote_uri="https://h/b", upstream_url="https://h/up")),
        "git_commits": table("git_commits", *commits),
        "git_branches": table("git_branches", dict(repo_id=1, name="main", is_default=True), dict(repo_id=1, name="dev", is_default=False)),
        "git_tags": table("git_tags", dict(repo_id=1, name="v1"), dict(repo_id=1, name="nightly")),
        "git_commit_files": table("git_commit_files", dict(id=20, commit_sha="c2", path="src/dog.py"), dict(id=30, commit_sha="c2", path="cat.go"), dict(id=40, commit_sha="d1", path="d.py")),
        "enrichments_v2": table("enrichments_v2", *[dict(id=i, type="development", subtype=s, content=c, language=lang, created_at=T) for i, _, s, c, lang in texts]),
        "enrichment_associations": table("enrichment_associations", *[dict(id=n, enrichment_id=i, entity_type=t, entity_id=e) for n, (i, t, e) in enumerate(edges)]),
        "source_locations": table("source_locations", dict(enrichment_id=2, page=0, start_line=3, end_line=9)),
        "keyword_index": table("keyword_index", *[dict(snippet_id=str(i), passage=c) for i, _, s, c, _ in texts if s == "chunk"]),
        "vector_index": table("vector_index", *[dict(snippet_id=str(i), task="code", embedding=v) for i, v in ((1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.8, 0.3]))]),
        "task_status": table("task_status", dict(id="p", trackable_type="repository", trackable_id=1, operation="sync", state="completed", updated_at=T, total=4, current=4), dict(id="q", parent="p", trackable_type="repository", trackable_id=1, operation="scan", state="failed", error="no", updated_at=T, total=4, current=1)),
        "tasks": table("tasks", dict(dedup_key="k", payload='{"repository_id": 2}')),
        "pipelines": table("pipelines", dict(id=1, name="default")), "steps": table("steps", dict(id=1, name="scan"), dict(id=2, name="chunks")),
        "pipeline_steps": table("pipeline_steps", dict(pipeline_id=1, step_id=1), dict(pipeline_id=1, step_id=2)), "step_dependencies": table("step_dependencies", dict(step_id=2, depends_on_id=1)),
    })


def ids(df):
    return [r["id"] for r in df.collect()]


def test_tables(catalog):
    rows = {r["repo_id"]: r for r in N.repositories(catalog).collect()}
    assert (rows[1]["branch_count"], rows[1]["tag_count"], rows[1]["commit_count"], rows[1]["default_branch"]) == (2, 2, 2, "main") and rows[2]["branch_count"] == 0
    assert N.find_repository(catalog, "https://h/up").first()["id"] == 2
    assert [r["commit_sha"] for r in N.commits(catalog, 1).collect()] == ["c1", "c2"] and N.latest_commit(catalog, 1).first()["commit_sha"] == "c2"
    assert [r["is_version"] for r in N.tags(catalog, 1).collect()] == [False, True]
    with pytest.raises(PermissionError):
        N.commits(catalog.scoped([2]), 1)
    assert N.repositories(catalog.scoped([2]).scoped([1])).count() == 0


def test_enrichments(catalog):
    assert ids(N.commit_enrichments(catalog, "c2", subtype="chunk")) == [2, 3]
    assert N.commit_enrichments(catalog, "c2").where("id = 2").first()["start_line"] == 3
    assert ids(N.repository_enrichments(catalog, 1)) == [1, 2, 3, 5, 6]
    snippet = N.commit_snippets(catalog, "c2").where("id = 2").first()
    assert [r["content"] for r in snippet["related"]] == ["about dogs"]
    left = N.cleanup_old(catalog, 1, "c2", "development", "chunk")
    assert sorted(ids(left["enrichments_v2"])) == [2, 3, 4, 5, 6] and left["keyword_index"].count() == 3 and left["enrichment_associations"].where("enrichment_id = 1").count() == 0


def test_search(catalog):
    found = N.semantic(catalog, [1.0, 0.0], k=2).collect()
    assert [r["id"] for r in found] == [1, 2] and found[1]["uri"] == "file://1/c2/src/dog.py?lines=L3-L9" and found[0]["path"] is None
    assert ids(N.semantic(catalog, [1.0, 0.0], Filters(source_repos=(2,)))) == [4]
    assert ids(N.semantic(catalog.scoped([2]), [1.0, 0.0], Filters(source_repos=(1,)))) == []
    assert ids(N.semantic(catalog, [1.0, 0.0], Filters(file_paths=("**/*.py",)))) == [2, 4] and ids(N.semantic(catalog, [1.0, 0.0], Filters(authors=("bob",)))) == [2, 3]
    assert ids(N.semantic(catalog, [0.0, 1.0], language=".go")) == [3]
    assert ids(N.keyword(catalog, "dog run")) == [4, 2] and ids(N.keyword(catalog, "run dog")) == []
    mixed = N.search(catalog, code=[1.0, 0.0], keywords=["dog", "cat"], k=3)
    # code ranks 1, 2, 4, 3; "dog" ranks 4 before 2, which is longer; "cat" finds 3
    scores = {1: 1 / 60, 2: 1 / 61 + 1 / 61, 4: 1 / 62 + 1 / 60, 3: 1 / 63 + 1 / 60}
    assert ids(mixed) == sorted(scores, key=scores.get, reverse=True)[:3] and [r["score"] for r in mixed.collect()] == pytest.approx(sorted(scores.values(), reverse=True)[:3])
    assert N.search(catalog).count() == 0


def test_readers(spark, catalog):
    contents = spark.createDataFrame([("c2", "a.py", "x\ndef f()"), ("c1", "a.py", "def g()")], "commit_sha string, path string, content string")
    hit = N.grep(catalog, contents, 1, "def").first()
    assert hit["path"] == "a.py" and len(hit["matches"]) == 1
    assert N.grep(catalog, contents, 1, "def").select(N.preview(F.col("matches"), 0)).first()[0].endswith("1 more")
    assert [r["path"] for r in N.listing(catalog, 1, "**/*.py").collect()] == ["src/dog.py"]
    assert N.read_lines(contents.where("commit_sha = 'c2'"), "a.py", "L2", True).first()["content"] == "2\tdef f()"
    assert N.document(catalog, 1, "development", "summary").first()["content"] == "about dogs"
    assert N.wiki_page(catalog, 1, "a") == "see [b](a/b)" and N.wiki_page(catalog, 1, "z") is None


def test_status(catalog):
    rows = N.status(catalog, 1).collect()
    assert {r["operation"]: r["percent"] for r in rows} == {"sync": 100.0, "scan": 25.0} and [r["parent_operation"] for r in rows if r["id"] == "q"] == ["sync"]
    assert N.status_summary(catalog, 1).first()["status"] == "failed" and N.status_summary(catalog, 2).first()["status"] == "in_progress"
    assert {r["name"]: r["depends_on"] for r in N.pipeline_steps(catalog).collect()} == {"scan": None, "chunks": [1]}


def test_unknown_references_meet_no_text(spark):
    """Addresses whose reference is not known have no content, and are not dealt with the others to the texts, where one path would gather them."""
    c = N.Catalog({"git_commits": spark.createDataFrame([(1, "a1")], "repo_id long, commit_sha string"), "git_tags": spark.createDataFrame([(1, "v1", "a1")], "repo_id long, name string, target_commit_sha string"), "git_branches": spark.createDataFrame([(1, "main", "b1")], "repo_id long, name string, head_commit_sha string")})
    texts = spark.createDataFrame([("a1", "x.py", "p\nq"), ("b1", "x.py", "r")], "commit_sha string, path string, content string")
    uris = ["file://1/a1/x.py", "file://1/v1/x.py?lines=L2&line_numbers=true", "file://1/main/x.py?lines=L9", "file://1/none/x.py", "file://2/a1/x.py?lines=L1", "file://1/a1/y.py", "nothing"]
    out = N.read_uris(c, texts, spark.createDataFrame([(u,) for u in uris], "uri string"))
    got = {r["uri"]: (r["commit_sha"], r["path"], r["content"]) for r in out.collect()}
    assert out.count() == len(uris) and [got[u] for u in uris[:6]] == [("a1", "x.py", "p\nq"), ("a1", "x.py", "2\tq"), ("b1", "x.py", ""), (None, "x.py", None), (None, "x.py", None), ("a1", "y.py", None)]
    assert got["nothing"][0] is None and got["nothing"][2] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
