"""Git repositories as DataFrames, by the git command on the executors.

Paths of repositories must be readable there, as on a shared volume.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, is_version_tag, language_of, media_type
from ..operators.relational import first_wins
from ..session import ship_package

#: Fields of a log record, parted by NUL; records are parted by SOH.
LOG_FIELDS = ("commit_sha", "parents", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "message")
LOG_FORMAT = "%x01%H%x00%P%x00%an%x00%ae%x00%aI%x00%cn%x00%ce%x00%cI%x00%B"


def git(path: str, *args: str, check: bool = True) -> bytes:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, check=check).stdout


def parse_log(logs: DataFrame, column: str = "log") -> DataFrame:
    """Commits of log texts; records with fewer than nine fields are dropped, only the first parent counts."""
    records = logs.select(*[c for c in logs.columns if c != column], F.explode(F.split(column, "\x01")).alias("r")).where("r <> ''")
    fields = records.withColumn("f", F.split("r", "\x00", len(LOG_FIELDS))).where(F.size("f") == len(LOG_FIELDS))
    at = {n: F.element_at("f", k + 1) for k, n in enumerate(LOG_FIELDS)}
    author = F.concat(at["author_name"], F.lit(" <"), at["author_email"], F.lit(">"))
    return fields.select(
        *[c for c in logs.columns if c != column], at["commit_sha"].alias("commit_sha"), F.nullif(F.split(at["parents"], " ")[0], F.lit("")).alias("parent_commit_sha"), author.alias("author"),
        F.to_timestamp(at["authored_at"]).alias("date"), F.to_timestamp(at["committed_at"]).alias("committed_at"), F.rtrim(F.regexp_replace(at["message"], r"\s+$", "")).alias("message"),
    )


def _per_repository(repos: DataFrame, command, schema: str, column: str = "path") -> DataFrame:
    """Rows that ``command(path, *others)`` yields for each repository; one task a repository at most."""
    ship_package(repos.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for args in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(command(*args))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    return repos.mapInArrow(run, schema)


def commits(repos: DataFrame, since: str | None = None) -> DataFrame:
    """All commits of all refs of the repositories (repo_id, path)."""
    extra = [f"--since={since}"] if since else []

    def log(repo: int, path: str):
        yield repo, git(path, "log", "--all", f"--format={LOG_FORMAT}", *extra).decode("utf-8", "replace")

    return parse_log(_per_repository(repos.select("repo_id", "path"), log, "repo_id long, log string")).dropDuplicates(["repo_id", "commit_sha"])


def tree(targets: DataFrame) -> DataFrame:
    """Files of commits (repo_id, path, commit_sha): blobs at any depth, without folders and submodules."""

    def listing(repo: int, path: str, sha: str):
        for line in git(path, "ls-tree", "-r", "-l", "-z", sha).decode("utf-8", "replace").split("\0"):
            if line:
                head, _, name = line.partition("\t")
                _, kind, blob, size = head.split()
                if kind == "blob":
                    yield repo, sha, name, blob, int(size)

    rows = _per_repository(targets.select("repo_id", "path", "commit_sha"), listing, "repo_id long, commit_sha string, file string, blob_sha string, size long")
    return rows.select("repo_id", "commit_sha", F.col("file").alias("path"), "blob_sha", "size", extension(F.col("file")).alias("extension"), language_of(F.col("file")).alias("language"), media_type(extension(F.col("file"))).alias("mime_type"))


def contents(targets: DataFrame) -> DataFrame:
    """Contents of files (repo_id, path, commit_sha, file) at their commits, by one git process a repository and task."""
    ship_package(targets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .git_source import Blobs

        at, blobs = None, None
        try:
            for batch in batches:
                for repo, path, sha, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != at:
                        if blobs:
                            blobs.__exit__()
                        at, blobs = path, Blobs(path)
                    # a name with a line feed is no request of the batch protocol
                    content = blobs.get(f"{sha}:{name}") if "\n" not in name else _one(path, sha, name)
                    if content is not None:
                        yield pa.RecordBatch.from_pylist([{"repo_id": repo, "commit_sha": sha, "file": name, "content": content}], schema=kinds)
        finally:
            if blobs:
                blobs.__exit__()

    kinds = pa.schema([("repo_id", pa.int64()), ("commit_sha", pa.string()), ("file", pa.string()), ("content", pa.binary())])
    rows = targets.select("repo_id", "path", "commit_sha", "file").sortWithinPartitions("path", "commit_sha", "file")
    return rows.mapInArrow(run, "repo_id long, commit_sha string, file string, content binary")


def _one(path: str, sha: str, name: str) -> bytes | None:
    done = subprocess.run(["git", "-C", path, "cat-file", "blob", f"{sha}:{name}"], capture_output=True)
    return done.stdout if done.returncode == 0 else None


def diffs(targets: DataFrame) -> DataFrame:
    """The diff of each commit (repo_id, path, commit_sha) against its first parent."""

    def show(repo: int, path: str, sha: str):
        yield repo, sha, git(path, "show", "--format=", "--first-parent", "-m", sha).decode("utf-8", "replace")

    return _per_repository(targets.select("repo_id", "path", "commit_sha"), show, "repo_id long, commit_sha string, diff string")


def branches(repos: DataFrame) -> DataFrame:
    """Branches, local ones before remote ones of the same name; the default is where HEAD stands."""

    def refs(repo: int, path: str):
        head = git(path, "rev-parse", "HEAD", check=False).decode().strip()
        for line in git(path, "for-each-ref", "--format=%(refname)%00%(objectname)", "refs/heads", "refs/remotes").decode("utf-8", "replace").splitlines():
            ref, _, sha = line.partition("\0")
            if ref.endswith("/HEAD"):
                continue
            local = ref.startswith("refs/heads/")
            yield repo, ref.split("/", 2 if local else 3)[-1], sha, sha == head, local

    rows = _per_repository(repos.select("repo_id", "path"), refs, "repo_id long, name string, head_commit_sha string, is_default boolean, local boolean")
    keyed = rows.withColumn("_key", F.struct("repo_id", "name"))
    return first_wins([keyed.where("local"), keyed.where("NOT local")], "_key").drop("_key", "local")


def tags(repos: DataFrame) -> DataFrame:
    """Tags; annotated ones have a message and a tagger."""

    def refs(repo: int, path: str):
        form = "%(refname:short)%00%(objectname)%00%(*objectname)%00%(contents:subject)%00%(taggername)%00%(taggeremail)%00%(taggerdate:iso-strict)"
        for line in git(path, "for-each-ref", f"--format={form}", "refs/tags").decode("utf-8", "replace").splitlines():
            name, sha, target, message, tagger, mail, when = line.split("\0")
            yield repo, name, target or sha, message if target else None, tagger or None, mail.strip("<>") or None, when or None

    rows = _per_repository(repos.select("repo_id", "path"), refs, "repo_id long, name string, target_commit_sha string, message string, tagger_name string, tagger_email string, tagged string")
    return rows.select("repo_id", "name", "target_commit_sha", "message", "tagger_name", "tagger_email", F.to_timestamp("tagged").alias("tagged_at"), is_version_tag(F.col("name")).alias("is_version"))


def latest_version(tagged: DataFrame) -> DataFrame:
    return tagged.where("is_version").groupBy("repo_id").agg(F.max_by("name", F.struct("tagged_at", "name")).alias("name"))


def branch_heads(branched: DataFrame) -> DataFrame:
    """(repo_id, heads, shas): each repository's branch heads by name, and the distinct ones in order."""
    entries = F.array_sort(F.collect_list(F.struct("name", "head_commit_sha")))
    return branched.groupBy("repo_id").agg(F.map_from_entries(entries).alias("heads"), F.array_sort(F.collect_set("head_commit_sha")).alias("shas"))


def latest_shas(branched: DataFrame) -> DataFrame:
    """(repo_id, commit_sha): the default branch's head, else that of main, master or the first branch."""
    order = F.when(F.col("is_default"), 0).when(F.col("name") == "main", 1).when(F.col("name") == "master", 2).otherwise(3)
    return branched.groupBy("repo_id").agg(F.min_by("head_commit_sha", F.struct(order, "name")).alias("commit_sha"))


def is_clone(path: str) -> bool:
    """A folder that git takes for a repository."""
    return (Path(path) / ".git").exists() and subprocess.run(["git", "-C", path, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def ensure_clone(uri: str, path: str, reference: str | None = None) -> str:
    """Clone, or fetch what is there, and check the reference out; a local source is not fetched.

    A folder that is no clone is replaced, and a clone that fails leaves nothing behind.
    """
    target = Path(path)
    if is_clone(path):
        if not uri.startswith("file://"):
            git(path, "fetch", "--all", "--prune", "--tags")
    else:
        shutil.rmtree(target, ignore_errors=True)
        try:
            subprocess.run(["git", "clone", "--quiet", uri, path], check=True, capture_output=True)
        except subprocess.CalledProcessError:
            shutil.rmtree(target, ignore_errors=True)
            raise
    if reference:
        checkout(path, reference)
    return path


def checkout(path: str, reference: str) -> None:
    git(path, "checkout", "--quiet", reference)


def pull(path: str) -> bool:
    """Bring the branch that is checked out up to its remote one; False where it has none."""
    if subprocess.run(["git", "-C", path, "rev-parse", "--abbrev-ref", "@{upstream}"], capture_output=True).returncode:
        return False
    git(path, "pull", "--quiet", "--ff-only")
    return True


def remove_clone(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def repositories(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(paths, 1)), "repo_id long, path string").repartition(max(1, len(paths)))


def resolve_reference(name: str, known_commits: set[str], tag_heads: dict[str, str], branch_heads: dict[str, str]) -> str:
    """A commit of that very name, else a tag, else a branch."""
    if name in known_commits:
        return name
    for heads in (tag_heads, branch_heads):
        if name in heads:
            return heads[name]
    raise KeyError(name)


def author(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))
