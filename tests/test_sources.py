import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.functions.registry import document_pages
from lodestone.sources import files, git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (path / "src").mkdir()
    (path / "src/a.py").write_text("def a():\n    pass\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nbody")
    run("tag", "light")
    (path / "README.md").write_text("hello\n")
    run("add", ".")
    run("commit", "-qm", "second")
    run("tag", "-a", "v1", "-m", "release")
    run("branch", "dev", "HEAD~1")
    return str(path)


def test_git(spark, repo):
    repos = git.repositories(spark, [repo])
    commits = {r["message"].split("\n")[0]: r for r in git.commits(repos).collect()}
    assert set(commits) == {"first", "second"} and commits["second"]["parent_commit_sha"] == commits["first"]["commit_sha"] and commits["first"]["parent_commit_sha"] is None
    assert commits["first"]["author"] == "A B <a@b>" and commits["first"]["message"].endswith("body")
    head = commits["second"]["commit_sha"]
    targets = repos.withColumn("commit_sha", F.lit(head))
    found = {r["path"]: r for r in git.tree(targets).collect()}
    assert set(found) == {"src/a.py", "README.md"} and found["src/a.py"]["language"] == "python" and found["README.md"]["size"] == 6
    shown = git.contents(targets.withColumn("file", F.lit("README.md"))).first()
    assert bytes(shown["content"]) == b"hello\n"
    assert "README.md" in git.diffs(targets).first()["diff"]
    branches = {r["name"]: r for r in git.branches(repos).collect()}
    assert branches["main"]["is_default"] and branches["dev"]["head_commit_sha"] == commits["first"]["commit_sha"]
    tags = {r["name"]: r for r in git.tags(repos).collect()}
    assert tags["v1"]["message"] == "release" and tags["v1"]["is_version"] and tags["light"]["message"] is None and tags["v1"]["target_commit_sha"] == head
    assert git.latest_version(git.tags(repos)).first()["name"] == "v1"


def test_clone(repo, tmp_path):
    target = str(tmp_path / "clone")
    assert git.ensure_clone(f"file://{repo}", target) == target == git.ensure_clone(f"file://{repo}", target)
    with pytest.raises(subprocess.CalledProcessError):
        git.ensure_clone(str(tmp_path / "none"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_resolve():
    assert git.resolve_reference("abc", {"abc"}, {}, {}) == "abc" and git.resolve_reference("v1", set(), {"v1": "t"}, {"v1": "b"}) == "t"
    with pytest.raises(KeyError):
        git.resolve_reference("x", set(), {}, {})


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x").write_text("no")
    (tmp_path / "sub/a.go").write_text("package a")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    rows = {r["path"]: r for r in files.scan_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"sub/a.go", "b.bin"} and rows["b.bin"]["text"] == "" and rows["sub/a.go"]["text"] == "package a" and rows["sub/a.go"]["language"] == "go"
    assert [r["path"] for r in files.scan_directory(spark, str(tmp_path), "**/*.go", with_content=False).collect()] == ["sub/a.go"]
    branch = files.directory_branch(files.scan_directory(spark, str(tmp_path))).first()
    assert branch["name"] == "main" and len(branch["head_commit_sha"]) == 40


def test_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "m", "p")], "instance_id string, model_name_or_path string, model_patch string")
    files.write_predictions(rows, f"{tmp_path}/p")
    assert files.read_predictions(spark, f"{tmp_path}/p").count() == 1
    (tmp_path / "map.json").write_text('{"a": {"model_name_or_path": "m", "model_patch": "x"}, "b": {"model_name_or_path": "m", "model_patch": ""}}')
    assert files.predictions_from_map(spark, f"{tmp_path}/map.json").count() == 2
    (tmp_path / "r.json").write_text('{"total_instances": 3, "resolved_ids": ["a"]}')
    assert files.read_results(spark, f"{tmp_path}/r.json").first()["resolved_ids"] == ["a"]
    (tmp_path / "d.json").write_text('[{"instance_id": "x", "repo": "r"}]')
    data = files.read_dataset(spark, f"{tmp_path}/d.json")
    assert files.find_instance(data, "x").count() == 1
    with pytest.raises(KeyError):
        files.find_instance(data, "y")


def test_cache(spark):
    requests = spark.createDataFrame([("GET", "u1", ""), ("GET", "u2", "")], "method string, url string, body string")
    cache = spark.createDataFrame([], "key string, status_code int, header binary, body binary")
    fetch = lambda missing: missing.select("key", F.when(F.col("url") == "u1", 200).otherwise(500).alias("status_code"), F.lit(None).cast("binary").alias("header"), F.encode("url", "UTF-8").alias("body"))
    answers, fresh = files.through_cache(requests, cache, fetch)
    assert answers.count() == 2 and fresh.count() == 1


def test_document_pages(spark):
    rows = spark.createDataFrame([("a.csv", "csv", bytearray(b"h\nv\n")), ("b.docx", "docx", bytearray(b"broken")), ("c.txt", "txt", bytearray(b"x"))], "path string, extension string, content binary")
    got = {r["path"]: r for r in document_pages(rows).collect()}
    assert got["a.csv"]["text"].startswith("Headers: h") and got["b.docx"]["error"] and got["c.txt"]["text"] == "x"
