from lodestone.plans import endpoints, enrich
from lodestone.streaming import status

from .test_endpoints import catalog  # noqa: F401


def test_api_docs(spark):
    code = "import x\ndef a():\n  pass\nclass B:\n  def c(self): pass\n"
    files = spark.createDataFrame([("c1", "p/a.py", "python", code), ("c1", "p/test_a.py", "python", code), ("c1", "n.txt", "", code), ("c2", "b.py", "python", "x = 1")], "commit_sha string, path string, language string, content string")
    got = {(r["commit_sha"], r["language"]): r["content"] for r in enrich.api_docs(files).collect()}
    assert got == {("c1", "python"): "### a.py (python)\n\n```python\ndef a():\nclass B:\n  def c(self): pass\n```", ("c2", ""): ""}


def test_descriptions(spark):
    diffs = spark.createDataFrame([("a", "x" * 200_000), ("b", ""), ("c", "y")], "commit_sha string, diff string")
    done = spark.createDataFrame([("c",)], "commit_sha string")
    (row,) = enrich.commit_descriptions(diffs, done, lambda s, t: f"<think>{s}</think>{len(t)}").collect()
    assert (row["commit_sha"], row["answer"]) == ("a", str(enrich.MOST_DIFF + len("\n[diff truncated]")))
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    assert [r["parent_id"] for r in enrich.summaries(chunks, spark.createDataFrame([(1,)], "parent_id long"), lambda s, t: t).collect()] == [2]


def test_context(spark):
    files = spark.createDataFrame([(1, "README.md", "r" * 5000), (1, "go.mod", "module"), (1, "src/a.go", "code"), (2, "x", None)], "repo_id long, path string, content string")
    got = {r["repo_id"]: r["context"] for r in enrich.repository_context(files).collect()}
    assert got[1] == "README\n" + "r" * 3000 + "\n\ngo.mod\nmodule\n\nFiles\nREADME.md\ngo.mod\nsrc/a.go" and got[2] == "Files\nx"


def test_whole_repositories(spark, catalog):  # noqa: F811
    left = endpoints.delete_repository(catalog, 1)
    assert [r["id"] for r in left["enrichments_v2"].collect()] == [4] and left["git_commits"].count() == 1 and left["git_repos"].count() == 1 and left["git_tags"].count() == 0 and left["git_commit_files"].count() == 1 and left["tasks"].count() == 1
    assert endpoints.delete_repository(catalog, 2)["tasks"].count() == 0
    assert endpoints.rescan(catalog, "c2")["git_commits"].count() == 2
    assert not endpoints.add_repository(catalog, "https://h/a", 9)[1]
    row, new = endpoints.add_repository(catalog, "https://me:pw@h/new", 9)
    assert new and row.first()["sanitized_remote_uri"] == "https://h/new"


def test_replay_and_fan_out(spark, tmp_path):
    events = spark.createDataFrame([(1, k, e) for k, e in enumerate(["start", "progress", "fail", "complete"])] + [(2, 0, "start"), (2, 1, "progress"), (3, 0, "skip")], "id int, at int, event string")
    assert {r["id"]: r["state"] for r in status.replay(events).collect()} == {1: "failed", 2: "in_progress", 3: "skipped"}
    want = "start"
    for e in ("start", "progress", "fail", "complete"):
        want = status.advance(None if want == "start" and e == "start" else want, e)
    assert want == "failed"
    events.write.parquet(f"{tmp_path}/e")
    seen = []

    def broken(batch, number):
        raise RuntimeError("no")

    query, failures = status.fan_out(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), [broken, lambda b, n: seen.append(b.count())], f"{tmp_path}/cp")
    assert query.awaitTermination(60) and sum(seen) == 7 and failures == ["RuntimeError: no"] * len(seen)
