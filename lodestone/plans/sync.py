"""From a repository's address to its indexed chunks: what is there already is skipped, the rest is planned here.

Steps that must touch a disk or a server (clone, fetch, list a tree, render a page) run on the
executors, one row each; what they run on, and what follows from it, are DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chunker import ChunkConfig
from ..functions.registry import RASTERIZERS
from ..operators import relational as R
from ..operators.tables import TableStore
from ..session import ship_package
from ..sources import git
from . import endpoints, ingest
from .dag import PRIORITIES
from .keyword import KeywordIndex


# --- repositories


def to_clone(repos: DataFrame) -> DataFrame:
    """(repo_id, uri) of repositories without a working copy."""
    known = set(repos.columns)
    uri = F.coalesce("remote_uri", "sanitized_remote_uri") if "remote_uri" in known else F.col("sanitized_remote_uri")
    return repos.where(F.coalesce("cloned_path", F.lit("")) == "").select(F.col("id").alias("repo_id"), uri.alias("uri"))


def clone(repos: DataFrame, folder: str) -> DataFrame:
    """(repo_id, cloned_path, error): clones of what is not cloned yet, below a folder that all executors share.

    A clone that fails leaves nothing behind and is reported; the others go on.
    """

    def run(repo: int, uri: str, name: str):
        path = f"{folder.rstrip('/')}/{name}"
        try:
            yield repo, git.ensure_clone(uri, path), None
        except Exception as e:  # noqa: BLE001  the source is not ours
            yield repo, None, f"{type(e).__name__}: {e}"

    rows = to_clone(repos).select("repo_id", "uri", X.uri_folder(F.col("uri")).alias("name"))
    return git._per_repository(rows, run, "repo_id long, cloned_path string, error string")


def remove_repository(c: endpoints.Catalog, repo: int) -> dict[str, DataFrame]:
    """All tables without a repository; its working copy, below the shared folder, is deleted."""
    left = endpoints.delete_repository(c, repo)
    for row in c["git_repos"].where(F.col("id") == repo).select("cloned_path").collect():
        if row["cloned_path"]:
            git.remove_clone(row["cloned_path"])
    return left


def chosen_commits(repos: DataFrame, branches: DataFrame) -> DataFrame:
    """(repo_id, commit_sha): the tracked branch's head, else the tracked commit, else the default branch's head, else the first one's.

    Repositories without any of these are left out.
    """
    heads = branches.groupBy("repo_id").agg(F.min(F.when(F.col("is_default"), F.col("head_commit_sha"))).alias("_default"), F.min_by("head_commit_sha", "name").alias("_first"))
    tracked = branches.groupBy("repo_id", F.col("name").alias("tracking_name")).agg(F.min("head_commit_sha").alias("_tracked"))
    rows = repos.select(F.col("id").alias("repo_id"), "tracking_type", "tracking_name").join(heads, "repo_id", "left").join(tracked, ["repo_id", "tracking_name"], "left")
    own = F.when(F.col("tracking_type") == "branch", F.col("_tracked")).when(F.col("tracking_type") == "commit", F.nullif("tracking_name", F.lit("")))
    return rows.select("repo_id", F.coalesce(own, "_default", "_first").alias("commit_sha")).where("commit_sha IS NOT NULL")


def default_tracking(branches: DataFrame) -> DataFrame:
    """(repo_id, tracking_type, tracking_name): the default branch, for repositories that track nothing yet."""
    return branches.where("is_default").groupBy("repo_id").agg(F.min("name").alias("tracking_name")).select("repo_id", F.lit("branch").alias("tracking_type"), "tracking_name")


def operation_tasks(targets: DataFrame, operations: Sequence[str], base: int = PRIORITIES["normal"]) -> DataFrame:
    """(dedup_key, type, payload, priority): the operations of a pipeline for each target, with falling priorities.

    The columns of ``targets`` are the payload.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("type"), F.lit(base + 10 * (len(operations) - i)).alias("priority")) for i, o in enumerate(operations)]))
    payload = F.to_json(F.struct(*targets.columns))
    rows = targets.select(payload.alias("payload"), steps.alias("s"))
    return rows.select(X.dedup_key(F.col("s.type"), F.col("payload")).alias("dedup_key"), "s.type", "payload", "s.priority")


def sync(repos: DataFrame, branches: DataFrame, operations: Sequence[str]) -> DataFrame:
    """The tasks of a sync: each repository's chosen commit through the pipeline's operations."""
    return operation_tasks(chosen_commits(repos, branches).select(F.col("commit_sha"), F.col("repo_id").alias("repository_id")), operations)


# --- commits


def to_scan(targets: DataFrame, commits: DataFrame) -> DataFrame:
    """The targets (commit_sha, …) that no commit is stored for."""
    return R.new_only(targets, commits, "commit_sha")


def scan(targets: DataFrame, commits: DataFrame, details: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Rows to add for the targets that are new: their commit and their files.

    ``details`` and ``files`` come from ``sources.git``; ids of files are hashes of commit and path, so a
    rerun makes the same rows.
    """
    fresh = to_scan(targets, commits).select("commit_sha").distinct()
    return {
        "git_commits": details.join(fresh, "commit_sha", "left_semi"),
        "git_commit_files": files.join(fresh, "commit_sha", "left_semi").withColumn("id", F.abs(F.xxhash64("commit_sha", "path"))),
    }


def chunk_commits(files: DataFrame, chunked: DataFrame, config: ChunkConfig = ChunkConfig()) -> dict[str, DataFrame]:
    """Chunks, locations and associations of the commits' files, for commits that have none yet.

    ``files`` holds id, repo_id, commit_sha, path and content, ``chunked`` the commits that are done.
    Only files that can be indexed count; one without content is skipped, whatever its reason.
    """
    rows = R.new_only(files.where(X.is_indexable(F.col("path"))), chunked, "commit_sha")
    return ingest.chunk_tables(ingest.chunk_files(rows, config), rows)


# --- indexes


def to_index(c: endpoints.Catalog, known: DataFrame, subtype: str, sha: str | None = None, kind: str = "development") -> DataFrame:
    """(commit_sha, id, snippet_id, text) of the commits' enrichments of a kind that an index (snippet_id) lacks; empty ones do not count."""
    edges = c["enrichment_associations"].where("entity_type = 'git_commits'").select(F.col("enrichment_id").alias("id"), F.col("entity_id").alias("commit_sha")).distinct()
    edges = edges if sha is None else edges.where(F.col("commit_sha") == sha)
    rows = c["enrichments_v2"].where((F.col("type") == kind) & (F.col("subtype") == subtype)).join(edges, "id")
    rows = rows.select("commit_sha", "id", F.col("id").cast("string").alias("snippet_id"), F.col("content").alias("text"))
    return R.new_only(rows, known, "snippet_id").where("text <> ''")


def index_keywords(c: endpoints.Catalog, index: KeywordIndex, sha: str, subtype: str = "chunk") -> tuple[int, str | None]:
    """Index a commit's chunks that are new: how many, and why none if none."""
    every = endpoints._of_commits(c, [sha]).where((F.col("type") == "development") & (F.col("subtype") == subtype))
    if every.isEmpty():
        return 0, "no chunks to index"
    known = index.store.read("docs").select(F.col("id").alias("snippet_id")) if index.exists else every.limit(0).select(F.col("id").cast("string").alias("snippet_id"))
    if R.new_only(every.select(F.col("id").cast("string").alias("snippet_id")), known, "snippet_id").isEmpty():
        return 0, "all chunks are indexed"
    fresh = to_index(c, known, subtype, sha)
    count = index.add(fresh.select(F.col("snippet_id").alias("id"), "text"))
    return count, None if count else "no chunk has a text"


def index_embeddings(c: endpoints.Catalog, store: TableStore, task: str, sha: str, model: Callable, subtype: str = "chunk", **options) -> tuple[int, str | None]:
    """Embed and store a commit's enrichments of a kind that are new, in order of their ids."""
    name = f"vectors_{task}"
    rows = endpoints._of_commits(c, [sha]).where((F.col("type") == "development") & (F.col("subtype") == subtype))
    if rows.isEmpty():
        return 0, "nothing to embed"
    known = store.read(name).select("snippet_id") if store.exists(name) else rows.limit(0).select(F.col("id").cast("string").alias("snippet_id"))
    count = ingest.index_vectors(store, task, to_index(c, known, subtype, sha).orderBy("id"), model, **options)
    return count, None if count else "all are embedded"


def index_summaries(c: endpoints.Catalog, store: TableStore, sha: str, model: Callable, **options) -> int:
    """Embed the summaries of a commit's chunks, each under the id of the chunk that it tells about."""
    parents = c["enrichment_associations"].where("entity_type = 'enrichments_v2'").select(F.col("enrichment_id").alias("id"), F.col("entity_id").alias("snippet_id"))
    chunks = endpoints._of_commits(c, [sha]).where("subtype = 'chunk'").select(F.col("id").cast("string").alias("snippet_id"))
    rows = c["enrichments_v2"].where("subtype = 'snippet_summary'").join(parents, "id").join(chunks, "snippet_id", "left_semi")
    return ingest.index_vectors(store, "text", rows.select("snippet_id", F.col("content").alias("text")), model, **options)


# --- page images


def page_images(files: DataFrame, done: DataFrame) -> DataFrame:
    """(id, repo_id, commit_sha, path, page, content) with an empty content: one row for each page that can be rendered.

    ``files`` holds repo_id, commit_sha, path and page_count; commits in ``done`` are skipped.
    """
    kinds = sorted(RASTERIZERS)
    rows = R.new_only(files.where(F.lower(X.extension(F.col("path"))).isin(kinds) if kinds else F.lit(False)), done, "commit_sha")
    return ingest.page_rows(rows).withColumn("id", F.abs(F.xxhash64("repo_id", "commit_sha", "path", F.lit("page"), "page")))


def rendered(jobs: DataFrame, rasterizers: dict[str, Callable[[bytes, int], bytes]] | None = None) -> DataFrame:
    """(snippet_id, image, error) of jobs (id, path, page, content): each page by the rasterizer of its file's extension.

    A page without a rasterizer, or that fails to render, keeps its row with the error.
    """
    ship_package(jobs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RASTERIZERS if rasterizers is None else rasterizers
        for batch in batches:
            for number, path, page, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                image, error = None, None
                try:
                    image = known[path.rsplit(".", 1)[-1].lower()](data or b"", page)
                except Exception as e:  # noqa: BLE001  files are not ours
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([str(number)]), pa.array([image], pa.binary()), pa.array([error], pa.string())], names=["snippet_id", "image", "error"])

    return jobs.select("id", "path", "page", "content").mapInArrow(run, "snippet_id string, image binary, error string")


def index_page_images(c: endpoints.Catalog, store: TableStore, sha: str, contents: DataFrame, model: Callable, rasterizers: dict[str, Callable] | None = None, batch: int = 8) -> int:
    """Render, embed and store a commit's page images that are new, ``batch`` at a time; how many.

    Images without a location, a file, a safe path or a rasterizer are skipped. The last batch of a
    partition is embedded however full it is, also if the rows after it are skipped.
    """
    jobs = endpoints.page_image_jobs(c, sha).where(X.is_safe_path(F.col("path")))
    if store.exists("vectors_vision"):
        jobs = R.new_only(jobs.withColumn("snippet_id", F.col("id").cast("string")), store.read("vectors_vision"), "snippet_id")
    pictures = rendered(jobs.join(contents.select("commit_sha", "path", "content"), ["commit_sha", "path"]), rasterizers).where("error IS NULL")
    fresh = ingest.embed_items(pictures, model, "snippet_id", "image", batch)
    return ingest.store_vectors(store, "vision", fresh)
