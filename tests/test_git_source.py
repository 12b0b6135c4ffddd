"""Git as a data source: rows, pruned partitions, one process for many files."""

import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.sources import git
from lodestone.sources.git_source import read_git


def run(path, *args, when=None):
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x"}
    if when:
        env |= {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    return subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    out = []
    for number in (1, 2):
        path = tmp_path_factory.mktemp(f"r{number}")
        run(path, "init", "-q", "-b", "main")
        shas = []
        for day in range(1, 6):
            (path / "src").mkdir(exist_ok=True)
            (path / "src" / f"f{day}.py").write_text(f"repo {number} day {day}\n" * day)
            (path / "ü.txt").write_bytes(b"\xff\x00 day %d" % day)
            run(path, "add", "-A")
            run(path, "commit", "-q", "-m", f"day {day}\n\nbody", when=f"2024-01-0{day}T12:00:00+00:00")
            shas.append(run(path, "rev-parse", "HEAD"))
        out.append((number, str(path), shas))
    return out


@pytest.fixture
def counted(tmp_path):
    """A git command that notes how it is called."""
    log, command = tmp_path / "calls", tmp_path / "git.sh"
    command.write_text(f'#!/bin/sh\necho "$3" >> {log}\nexec git "$@"\n')
    command.chmod(0o755)
    return str(command), lambda: log.read_text().split() if log.exists() else []


def test_commits(spark, repos):
    rows = read_git(spark, [r[:2] for r in repos])
    got = sorted(map(tuple, rows.select("repo_id", "commit_sha", "parent_commit_sha", "author", "message").collect()))
    assert got == sorted((n, sha, ([None, *shas])[k], "A <a@x>", f"day {k + 1}\n\nbody") for n, _, shas in repos for k, sha in enumerate(shas))
    late = read_git(spark, [r[:2] for r in repos], since=dt.datetime(2024, 1, 4, 12, tzinfo=dt.timezone.utc))
    assert sorted(r["message"][:5] for r in late.collect()) == ["day 4", "day 4", "day 5", "day 5"]
    plain = git.commits(git.repositories(spark, [r[1] for r in repos]))
    assert sorted(map(tuple, plain.select("repo_id", "commit_sha", "date", "committed_at").collect())) == sorted(map(tuple, rows.select("repo_id", "commit_sha", "date", "committed_at").collect()))


def test_partitions_are_pruned(spark, repos, counted):
    command, calls = counted
    load = lambda **more: read_git(spark, [r[:2] for r in repos], commits_a_partition=2, git=command, **more)
    assert load().rdd.getNumPartitions() == 6 and load(repo_ids=[2]).rdd.getNumPartitions() == 3
    sha = repos[0][2][2]
    named = load(shas=[sha, "none"])
    assert named.rdd.getNumPartitions() == 1 and [r["message"][:5] for r in named.collect()] == ["day 3"]
    # one DataFrame, many plans
    rows = load()
    assert rows.where("repo_id = 9").count() == 0 and rows.where("repo_id = 2").count() == 5 and rows.where("repo_id = 1 OR repo_id = 2").count() == 10


def test_filters_are_pushed(spark, repos):
    """With ``pushdown``, the filters of a plan prune partitions; conditions that the source answers in part are checked again."""
    load = lambda kind="commits", **more: read_git(spark, [r[:2] for r in repos], kind, commits_a_partition=2, pushdown=True, **more)
    one = load().where("repo_id = 2")
    assert one.rdd.getNumPartitions() == 3 and {r["repo_id"] for r in one.collect()} == {2}
    named = load().where((F.col("repo_id") == 1) & F.col("commit_sha").isin(repos[0][2][:2] + repos[1][2][:1]))
    assert named.rdd.getNumPartitions() == 1 and named.count() == 2
    assert load().where("repo_id = 9").count() == 0 and load().where("commit_sha = 'none'").count() == 0 and load().where("repo_id = 1 OR repo_id = 2").count() == 10
    late = load().where(F.col("committed_at") >= dt.datetime(2024, 1, 4, 12, tzinfo=dt.timezone.utc))
    assert late.rdd.getNumPartitions() == 2 and sorted(r["message"][:5] for r in late.collect()) == ["day 4", "day 4", "day 5", "day 5"]
    files = load("files").where(F.col("path").startswith("src/f1"))
    assert sorted((r["repo_id"], r["path"]) for r in files.collect()) == [(1, "src/f1.py"), (2, "src/f1.py")]


def test_files_and_contents(spark, repos):
    heads = read_git(spark, [r[:2] for r in repos], "contents")
    got = {(r["repo_id"], r["path"]): bytes(r["content"]) for r in heads.collect()}
    assert len(got) == 12 and got[1, "src/f3.py"] == b"repo 1 day 3\n" * 3 and got[2, "ü.txt"] == b"\xff\x00 day 5"
    everything = read_git(spark, [r[:2] for r in repos], "files", commits="all")
    assert everything.count() == 2 * sum(k + 1 for k in range(1, 6))
    assert sorted(r["path"] for r in heads.where("repo_id = 1 AND path LIKE 'src/f1%'").collect()) == ["src/f1.py"]
    some = read_git(spark, [r[:2] for r in repos], "contents", shas=[repos[1][2][0]], paths=["ü.txt", "none"])
    assert [bytes(r["content"]) for r in some.collect()] == [b"\xff\x00 day 1"]
    assert heads.where("size > 30").select("path").distinct().count() == 3


def test_one_process_for_many_files(spark, tmp_path, counted):
    command, calls = counted
    path = tmp_path / "many"
    path.mkdir()
    run(path, "init", "-q", "-b", "main")
    for k in range(1000):
        (path / f"f{k}.txt").write_text(f"file {k}")
    run(path, "add", "-A")
    run(path, "commit", "-q", "-m", "all")
    rows = read_git(spark, [(1, str(path))], "contents", parts=1, git=command)
    assert {bytes(r["content"]) for r in rows.collect()} == {f"file {k}".encode() for k in range(1000)}
    assert calls().count("cat-file") == 1
    targets = rows.select("repo_id", F.lit(str(path)).alias("path"), "commit_sha", F.col("path").alias("file"))
    assert git.contents(targets.unionByName(targets.limit(1).withColumn("file", F.lit("none")))).count() == 1000
