"""Git repositories as a Spark data source: ``spark.read.format("git")``.

Partitions are ranges of a repository's commits, or shares of a commit's files. What is asked of repositories,
commits, paths and times reaches the source, so other repositories and commits become no partition and other files
are never read. Contents come from one ``git cat-file --batch`` process a partition, however many files it has.

:func:`read_git` takes such conditions as arguments. With the option ``pushdown`` they also come from the filters of
a plan. Spark keeps what the first plan of a DataFrame has pushed, so such a DataFrame is for one plan alone; that
is why the option is off unless it is asked for.
"""

from __future__ import annotations

import datetime as dt
import json
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from ..session import ship_package

_COMMITS = "repo_id long, commit_sha string, parent_commit_sha string, author string, date timestamp, committed_at timestamp, message string"
_FILES = "repo_id long, commit_sha string, path string, blob_sha string, size long"
SCHEMAS = {"commits": _COMMITS, "files": _FILES, "contents": f"{_FILES}, content binary"}
#: Commits of a partition, and rows and bytes of a batch.
COMMITS_A_PARTITION, BATCH_ROWS, BATCH_BYTES = 1000, 512, 1 << 22
_FORMAT = "%H%x00%P%x00%an%x00%ae%x00%aI%x00%cI%x00%B"


class Blobs:
    """One ``git cat-file --batch`` process that answers request by request."""

    def __init__(self, path: str, command: str = "git") -> None:
        self.process = subprocess.Popen([command, "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def __enter__(self) -> Blobs:
        return self

    def __exit__(self, *_: object) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def get(self, name: str) -> bytes | None:
        """The content of a blob, by its id or as commit:path; None for what is missing or no blob."""
        self.process.stdin.write(name.encode("utf-8", "surrogateescape") + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().rsplit(b" ", 2)
        if len(head) < 3 or not head[2].strip().isdigit():
            return None
        content = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return content if head[1] == b"blob" else None


def tree_of(path: str, sha: str, below: Iterable[str] = (), command: str = "git") -> list[tuple[str, str, int]]:
    """(path, blob, size) of the files of a commit; ``below`` are the files or folders wanted, all if none are given."""
    out = subprocess.run([command, "-C", path, "ls-tree", "-r", "-l", "-z", "--full-tree", sha, *(["--", *below] if below else [])], capture_output=True, check=True).stdout
    found = []
    for line in out.decode("utf-8", "surrogateescape").split("\0"):
        if line:
            head, _, name = line.partition("\t")
            _, kind, blob, size = head.split()
            if kind == "blob":
                found.append((name, blob, int(size)))
    return found


@dataclass
class Share(InputPartition):
    """Some commits of a repository, or the ``part``-th of ``parts`` shares of a commit's files."""

    repo: int
    path: str
    commits: list[str]
    part: int = 0
    parts: int = 1

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Wanted:
    """What the pushed filters ask for; None asks for everything."""

    repos: set[int] | None = None
    commits: set[str] | None = None
    paths: set[str] | None = None
    folders: list[str] = field(default_factory=list)
    since: dt.datetime | None = None


def _both(known: set | None, more: set) -> set:
    return more if known is None else known & more


class GitReader(DataSourceReader):
    def __init__(self, kind: str, schema: StructType, options: dict[str, str]) -> None:
        known = {name: json.loads(options[name]) for name in ("repo_ids", "shas", "paths") if name in options}
        since = dt.datetime.fromisoformat(options["since"]) if "since" in options else None
        self.kind, self.schema, self.pushdown = kind, schema, options.get("pushdown", "false").lower() == "true"
        self.wanted = Wanted(*(set(known[name]) if name in known else None for name in ("repo_ids", "shas", "paths")), since=since)
        self.repos = [(int(r), p) for r, p in json.loads(options["repositories"])]
        self.command, self.heads_only = options.get("git", "git"), options.get("commits", "heads") == "heads"
        self.range, self.parts = int(options.get("commits_a_partition", COMMITS_A_PARTITION)), int(options.get("parts", 4))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        w = self.wanted
        if not self.pushdown:
            yield from filters
            return
        for f in filters:
            name = getattr(f, "attribute", (None,))[-1]
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and name == "repo_id":
                w.repos = _both(w.repos, values)
            elif values is not None and name == "commit_sha":
                w.commits = _both(w.commits, values)
            elif values is not None and name == "path" and self.kind != "commits":
                w.paths = _both(w.paths, values)
            else:
                if isinstance(f, StringStartsWith) and name == "path" and "/" in f.value:
                    # the folder is git's part, the rest of the prefix is Spark's
                    w.folders.append(f.value.rsplit("/", 1)[0] + "/")
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "committed_at" and self.kind == "commits":
                    w.since = max(f.value, w.since) if w.since else f.value
                yield f

    def _git(self, path: str, *args: str, **more: object) -> str:
        return subprocess.run([self.command, "-C", path, *args], capture_output=True, check=True, **more).stdout.decode("utf-8", "replace")

    def _shas(self, path: str) -> list[str]:
        """The commits that are wanted of a repository, and that it has."""
        if self.wanted.commits is not None:
            asked = sorted(c for c in self.wanted.commits if c)
            # one process checks them all
            said = self._git(path, "cat-file", "--batch-check", input="".join(f"{c}^{{commit}}\n" for c in asked).encode())
            return [c for c, line in zip(asked, said.splitlines(), strict=True) if line.split()[0] == c]
        if self.kind != "commits" and self.heads_only:
            done = subprocess.run([self.command, "-C", path, "rev-parse", "--verify", "-q", "HEAD^{commit}"], capture_output=True)
            return done.stdout.decode().split()
        since = [f"--since={(self.wanted.since - dt.timedelta(seconds=1)).isoformat()}"] if self.wanted.since else []
        return self._git(path, "rev-list", "--all", *since).split()

    def partitions(self) -> list[Share]:
        out = []
        for repo, path in self.repos:
            if self.wanted.repos is not None and repo not in self.wanted.repos:
                continue
            shas = self._shas(path)
            if self.kind == "contents":
                parts = 1 if self.wanted.paths is not None else self.parts
                out += [Share(repo, path, [sha], part, parts) for sha in shas for part in range(parts)]
            else:
                out += [Share(repo, path, shas[at : at + self.range]) for at in range(0, len(shas), self.range)]
        # Spark wants a partition even where nothing is left
        return out or [Share(0, "", [])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows = {"commits": self._commits, "files": self._files, "contents": self._contents}[self.kind](share) if share.commits else iter(())
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[-1]) if isinstance(row[-1], (bytes, str)) else 0
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", tz="UTC"), "binary": pa.binary()}
        types = [kinds[f.dataType.simpleString()] for f in self.schema.fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=self.schema.names)

    def _commits(self, share: Share) -> Iterator[tuple]:
        log = self._git(share.path, "log", "--no-walk=unsorted", "--stdin", "-z", f"--format={_FORMAT}", input="".join(f"{s}\n" for s in share.commits).encode())
        fields = log.split("\0")
        # a record is seven fields, and a NUL ends each record as it parts its fields
        for at in range(0, len(fields) - 6, 7):
            sha, parents, name, mail, written, committed, message = fields[at : at + 7]
            yield share.repo, sha.strip(), parents.split(" ")[0] or None, f"{name} <{mail}>", _instant(written), _instant(committed), message.rstrip()

    def _listed(self, share: Share, sha: str) -> list[tuple[str, str, int]]:
        w = self.wanted
        below = sorted(w.paths) if w.paths is not None else [max(w.folders, key=len)] if w.folders else []
        if w.paths is not None and not below:
            return []
        return [f for f in tree_of(share.path, sha, below, self.command) if w.paths is None or f[0] in w.paths]

    def _files(self, share: Share) -> Iterator[tuple]:
        for sha in share.commits:
            for name, blob, size in self._listed(share, sha):
                yield share.repo, sha, _plain(name), blob, size

    def _contents(self, share: Share) -> Iterator[tuple]:
        with Blobs(share.path, self.command) as blobs:
            for sha in share.commits:
                for name, blob, size in self._listed(share, sha)[share.part :: share.parts]:
                    yield share.repo, sha, _plain(name), blob, size, blobs.get(blob)


def _plain(name: str) -> str:
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).astimezone(dt.timezone.utc)


class GitDataSource(DataSource):
    """Options: ``repositories`` (JSON, [[repo_id, path], ...]), ``kind`` (commits, files, contents), ``commits`` (heads or all, of files),
    ``parts`` (shares of a commit's contents), ``repo_ids``, ``shas``, ``paths`` (JSON lists), ``since`` (of commits), ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "commits")]

    def reader(self, schema: StructType) -> GitReader:
        return GitReader(self.options.get("kind", "commits"), schema, dict(self.options))


def read_git(spark: SparkSession, repositories: list[tuple[int, str]], kind: str = "commits", repo_ids: list[int] | None = None, shas: list[str] | None = None, paths: list[str] | None = None, since: dt.datetime | None = None, **options: object) -> DataFrame:
    """A kind of rows of repositories (repo_id, path): commits, files or contents, of these ids, commits and paths alone.

    ``since`` bounds the time that commits were made at, to the second. Without ``shas``, files and contents are those
    of each HEAD, or of all commits with ``commits="all"``.
    """
    ship_package(spark)
    spark.dataSource.register(GitDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("git").option("repositories", json.dumps([list(r) for r in repositories])).option("kind", kind)
    asked = {"repo_ids": repo_ids, "shas": shas, "paths": paths}
    given = {name: json.dumps(v) for name, v in asked.items() if v is not None} | ({"since": since.isoformat()} if since else {})
    for name, value in (given | options).items():
        reader = reader.option(name, str(value))
    return reader.load()
