"""Endpoints: each a plan over the stored tables, composed of the operators.

A :class:`Catalog` names the tables (see ``schemas``); what a caller may see is a set of repositories,
None for all. A scope without repositories sees nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents as D
from ..functions.chunker import ChunkConfig
from ..functions import text as X
from ..operators import options as O
from ..operators import relational as R
from ..operators.tables import TableStore, Transaction
from . import retrieval


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, DataFrame]
    scope: frozenset[int] | None = None
    extra: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def scoped(self, allowed: Iterable[int]) -> Catalog:
        allowed = frozenset(allowed)
        return Catalog(self.tables, allowed if self.scope is None else allowed & self.scope, self.extra)

    def repos(self) -> DataFrame:
        rows = self["git_repos"]
        return rows if self.scope is None else rows.where(F.col("id").isin(sorted(self.scope)) if self.scope else F.lit(False))

    def check(self, repo: int) -> None:
        if self.scope is not None and repo not in self.scope:
            raise PermissionError(f"repository {repo}")


# --- repositories, commits, files


def repositories(c: Catalog) -> DataFrame:
    """Repositories with counts of branches, tags and commits and the name of the default branch."""
    repos = c.repos().withColumnRenamed("id", "repo_id")
    out = R.repository_summary(repos, "repo_id", {"branch_count": c["git_branches"].select("repo_id"), "tag_count": c["git_tags"].select("repo_id"), "commit_count": c["git_commits"].select("repo_id")})
    default = c["git_branches"].where("is_default").groupBy("repo_id").agg(F.min("name").alias("default_branch"))
    return out.join(default, "repo_id", "left")


def find_repository(c: Catalog, url: str) -> DataFrame:
    """By sanitized address, else by the address it was forked from."""
    rows = c.repos().withColumn("_by", F.when(F.col("sanitized_remote_uri") == url, 0).when(F.col("upstream_url") == url, 1))
    return rows.where("_by IS NOT NULL").orderBy("_by", "id").limit(1).drop("_by")


def commits(c: Catalog, repo: int, page: int = 1, size: int = 20) -> DataFrame:
    c.check(repo)
    return O.build(O.with_repo_id(repo), O.with_pagination(size, (page - 1) * size)).apply(c["git_commits"], key="commit_sha")


def latest_commit(c: Catalog, repo: int) -> DataFrame:
    c.check(repo)
    return c["git_commits"].where(F.col("repo_id") == repo).orderBy(F.desc("date"), "commit_sha").limit(1)


def commit_files(c: Catalog, sha: str, page: int = 1, size: int = 20) -> DataFrame:
    return O.build(O.with_commit_sha(sha), O.with_pagination(size, (page - 1) * size)).apply(c["git_commit_files"], key="path")


def tags(c: Catalog, repo: int, page: int = 1, size: int = 20) -> DataFrame:
    c.check(repo)
    rows = c["git_tags"].withColumn("is_version", X.is_version_tag(F.col("name")))
    return O.build(O.with_repo_id(repo), O.with_pagination(size, (page - 1) * size)).apply(rows, key="name")


# --- enrichments


def _of_commits(c: Catalog, shas: Sequence[str] | DataFrame) -> DataFrame:
    edges = c["enrichment_associations"].where("entity_type = 'git_commits'")
    hit = edges.join(shas.select(F.col("commit_sha").alias("entity_id")), "entity_id", "left_semi") if isinstance(shas, DataFrame) else edges.where(F.col("entity_id").isin(list(shas)))
    return c["enrichments_v2"].join(hit.select(F.col("enrichment_id").alias("id")), "id", "left_semi")


def commit_enrichments(c: Catalog, sha: str, kind: str | None = None, subtype: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A commit's enrichments with their lines; each once, however many edges lead to it."""
    rows = _of_commits(c, [sha])
    options = [o for o in (kind and O.with_type(kind), subtype and O.with_subtype(subtype)) if o]
    found = O.build(*options, O.with_pagination(size, (page - 1) * size)).apply(rows, key="id")
    return with_lines(c, found)


def repository_enrichments(c: Catalog, repo: int, most_commits: int = 100, page: int = 1, size: int = 20) -> DataFrame:
    c.check(repo)
    shas = c["git_commits"].where(F.col("repo_id") == repo).orderBy("commit_sha").limit(most_commits)
    return O.build(O.with_pagination(size, (page - 1) * size)).apply(_of_commits(c, shas), key="id")


def enrichments(c: Catalog, kind: str | None = None, subtype: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """All enrichments of a kind with their lines, a page in order of their ids."""
    options = [o for o in (kind and O.with_type(kind), subtype and O.with_subtype(subtype)) if o]
    return with_lines(c, O.build(*options, O.with_pagination(size, (page - 1) * size)).apply(c["enrichments_v2"], key="id"))


def enrichment(c: Catalog, number: int) -> DataFrame:
    return with_lines(c, c["enrichments_v2"].where(F.col("id") == number))


def patch_enrichment(c: Catalog, number: int, content: str) -> DataFrame:
    """The enrichments with another content of one of them; an unknown id changes nothing."""
    return c["enrichments_v2"].withColumn("content", F.when(F.col("id") == number, content).otherwise(F.col("content")))


def repository_ids(c: Catalog) -> DataFrame:
    """(id, repo_id) of enrichments that belong to a repository; of several the last association counts."""
    edges = c["enrichment_associations"].where("entity_type = 'git_repos'").select(F.col("enrichment_id").alias("id"), F.col("id").alias("edge"), F.col("entity_id").try_cast("long").alias("repo_id"))
    return edges.where("repo_id IS NOT NULL").groupBy("id").agg(F.max_by("repo_id", "edge").alias("repo_id"))


def page_image_jobs(c: Catalog, sha: str | None = None, subtype: str = "page_image") -> DataFrame:
    """(id, page, file_id, path, commit_sha) of page images: those with a location and a file, of one commit or of all."""
    rows = c["enrichments_v2"].where(F.col("subtype") == subtype) if sha is None else _of_commits(c, [sha]).where(F.col("subtype") == subtype)
    where = c["source_locations"].select(F.col("enrichment_id").alias("id"), "page")
    first = R.latest_per_key(_files(c), ["id"], F.col("edge")).drop("edge")
    return rows.select("id").join(where, "id").join(first, "id")


def source_files(c: Catalog) -> DataFrame:
    """(id, file_id, path, commit_sha) of every enrichment and each file it stands in; ids that are no numbers are skipped."""
    return _files(c).drop("edge")


def with_lines(c: Catalog, rows: DataFrame) -> DataFrame:
    where = c["source_locations"].select(F.col("enrichment_id").alias("id"), *[F.nullif(n, F.lit(0)).alias(n) for n in ("page", "start_line", "end_line")])
    return rows.join(where, "id", "left")


def commit_snippets(c: Catalog, sha: str) -> DataFrame:
    """Chunks of a commit, each with the texts derived from it."""
    return with_related(c, _of_commits(c, [sha]).where("subtype = 'chunk'"))


def with_related(c: Catalog, rows: DataFrame) -> DataFrame:
    edges = c["enrichment_associations"].where("entity_type = 'enrichments_v2'").select(F.col("enrichment_id").alias("child"), F.col("entity_id").try_cast("long").alias("id"))
    texts = c["enrichments_v2"].select(F.col("id").alias("child"), F.col("subtype").alias("_s"), F.col("content").alias("_c"))
    grouped = edges.join(texts, "child").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("child").alias("id"), F.col("_s").alias("subtype"), F.col("_c").alias("content")))).alias("related"))
    return rows.join(grouped, "id", "left")


def enrichment_keys(c: Catalog, ids: DataFrame) -> dict[str, DataFrame]:
    """Of every table that knows an enrichment: the keys of the given ones."""
    text, number = ids.select(F.col("id").cast("string").alias("snippet_id")), ids.select(F.col("id").alias("enrichment_id"))
    return {n: text for n in ("keyword_index", "vector_index") if n in c.tables} | {"enrichments_v2": ids.select("id"), "enrichment_associations": number, "source_locations": number}


def without(c: Catalog, keys: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows of these keys."""
    return {name: c[name].join(gone.distinct(), gone.columns, "left_anti") for name, gone in keys.items()}


def erase(store: TableStore, keys: dict[str, DataFrame]) -> None:
    """Delete the rows of these keys from stored tables, in one commit that writes the keys alone."""

    def change(tx: Transaction) -> None:
        for name, gone in keys.items():
            tx.delete(name, gone)

    store.update(change)


def delete_enrichments(c: Catalog, ids: DataFrame) -> dict[str, DataFrame]:
    """Every table that knows an enrichment, without the given ones."""
    return without(c, enrichment_keys(c, ids))


def cleanup_old(c: Catalog, repo: int, sha: str, kind: str, subtype: str) -> dict[str, DataFrame]:
    """After a commit was processed: drop what older commits of the repository left of that kind."""
    old = c["git_commits"].where((F.col("repo_id") == repo) & (F.col("commit_sha") != sha))
    gone = _of_commits(c, old).where((F.col("type") == kind) & (F.col("subtype") == subtype)).join(_of_commits(c, [sha]).select("id"), "id", "left_anti")
    return delete_enrichments(c, gone.select("id"))


# --- search


def candidates(c: Catalog, filters: O.Filters = O.Filters()) -> DataFrame:
    """Ids that the filters and the scope leave, as (id, snippet_id); semi joins, so each once."""
    if c.scope is not None:
        filters = filters.scoped(c.scope)
    rows = c["enrichments_v2"].where(filters.predicate({"languages": "language", "types": "type", "subtypes": "subtype", "created": "created_at"}))
    edges = c["enrichment_associations"].where("entity_type = 'git_commits'").select(F.col("enrichment_id").alias("id"), F.col("entity_id").alias("commit_sha"))
    if filters.commit_shas is not None or filters.source_repos is not None or filters.authors is not None:
        known = edges.join(c["git_commits"].select("commit_sha", "repo_id", "author"), "commit_sha")
        hit = known.where(filters.predicate({"commit_shas": "commit_sha", "source_repos": "repo_id", "authors": "author"}))
        rows = rows.join(hit.select("id"), "id", "left_semi")
    if filters.file_paths is not None:
        hit = _files(c).where(filters.predicate({"file_paths": "path"}))
        rows = rows.join(hit.select("id"), "id", "left_semi")
    return rows.select("id", F.col("id").cast("string").alias("snippet_id"))


def _files(c: Catalog) -> DataFrame:
    """(id, file_id, path, commit_sha, edge) of enrichments that stand in a file."""
    edges = c["enrichment_associations"].where("entity_type = 'git_commit_files'").select(F.col("enrichment_id").alias("id"), F.col("entity_id").try_cast("long").alias("file_id"), F.col("id").alias("edge"))
    return edges.join(c["git_commit_files"].select(F.col("id").alias("file_id"), "path", "commit_sha"), "file_id")


def hydrate(c: Catalog, results: DataFrame, with_file_only: bool = False) -> DataFrame:
    """Results (id as text, score) with content, file, lines, commit, repository, link and related texts.

    The first file of an entry counts; a part that is missing stays null.
    """
    rows = R.hydrate(results.select(F.col("id").alias("_key"), "score"), c["enrichments_v2"], "_key").drop("_key")
    first = R.latest_per_key(_files(c).join(rows.select("id"), "id", "left_semi"), ["id"], F.col("edge")).drop("edge")
    rows = rows.join(first, "id", "inner" if with_file_only else "left")
    rows = rows.join(c["git_commits"].select("commit_sha", "repo_id"), "commit_sha", "left")
    rows = rows.join(c["git_repos"].select(F.col("id").alias("repo_id"), "sanitized_remote_uri"), "repo_id", "left")
    rows = with_related(c, with_lines(c, rows))
    link = F.when(F.col("path").isNotNull() & F.col("repo_id").isNotNull(), X.file_uri(F.col("repo_id"), F.col("commit_sha"), F.col("path"), F.coalesce("start_line", F.lit(0)), F.col("end_line")))
    return rows.withColumn("uri", link).orderBy(F.desc("score"), "id")


def search(c: Catalog, code: Sequence[float] | None = None, text: Sequence[float] | None = None, keywords: Sequence[str] = (), filters: O.Filters = O.Filters(), k: int = 10) -> DataFrame:
    """Hybrid search: the code and text vectors and one keyword list each, fused to k and hydrated."""
    k = k if k > 0 else retrieval.TOP
    allowed, lists = candidates(c, filters), []
    for task, vector in (("text", text), ("code", code)):
        if vector is not None:
            rows = c["vector_index"].where(F.col("task") == task).select(F.col("snippet_id").alias("id"), "embedding")
            lists.append(retrieval.exact_topk(rows, vector, retrieval.PER_LIST * k, allowed=allowed.select(F.col("snippet_id").alias("id"))))
    for word in keywords:
        lists.append(keyword_list(c, word, allowed, retrieval.PER_LIST * k))
    if not lists:
        return hydrate(c, allowed.limit(0).select(F.col("snippet_id").alias("id"), F.lit(0.0).alias("score")))
    ranked = [retrieval.with_rank(r, n) for n, r in enumerate(lists)]
    return hydrate(c, retrieval.fuse(R.reduce_union(ranked), "id", k).select("id", "score"))


def simple_search(c: Catalog, vector: Sequence[float], filters: O.Filters = O.Filters(), k: int = 10) -> DataFrame:
    """One vector for code and text, no keywords."""
    return search(c, code=vector, text=vector, filters=filters, k=k)


def keyword_list(c: Catalog, words: str, allowed: DataFrame, k: int) -> DataFrame:
    """(id, score) of the phrase among the allowed ids; frequencies are those of the whole index.

    The catalog's stored index (``extra["keywords"]``) is read if it has one, else the passages.
    """
    allowed = allowed.select(F.col("snippet_id").alias("id"))
    if (index := c.extra.get("keywords")) is not None:
        return index.find(words, k, allowed)
    docs = c["keyword_index"].select(F.col("snippet_id").alias("id"), F.col("passage").alias("text"))
    return retrieval.bm25_phrase(retrieval.postings(docs, analyzer="porter"), retrieval.ANALYZERS["porter"](words), k, allowed=allowed)


def semantic(c: Catalog, vector: Sequence[float], filters: O.Filters = O.Filters(), k: int = 10, task: str = "code", least: float | None = None, language: str | None = None) -> DataFrame:
    """Scored vector search; the language is a filter after the search, as with keywords."""
    rows = c["vector_index"].where(F.col("task") == task).select(F.col("snippet_id").alias("id"), "embedding")
    found = retrieval.exact_topk(rows, vector, k if k > 0 else retrieval.TOP, allowed=candidates(c, filters).select(F.col("snippet_id").alias("id")), least=least)
    out = hydrate(c, found)
    return out if language is None else out.where(X.strip_dot(F.col("language")) == language.removeprefix("."))


def visual(c: Catalog, vector: Sequence[float], filters: O.Filters = O.Filters(), k: int = 10, least: float | None = None) -> DataFrame:
    """Page images by the vector of a text or picture; each with its page's raster link."""
    found = semantic(c, vector, filters, k, task="vision", least=least)
    raster = F.when(F.col("path").isNotNull() & F.col("repo_id").isNotNull(), F.concat(X.file_uri(F.col("repo_id"), F.col("commit_sha"), F.col("path"), page=F.coalesce("page", F.lit(0))), F.when(F.coalesce("page", F.lit(0)) > 0, "&mode=raster").otherwise("?mode=raster")))
    return found.withColumn("uri", raster)


def in_repository(rows: DataFrame, repo: int | None, k: int = 0) -> DataFrame:
    """Hydrated results of one repository: a filter after the search's limit, so fewer than k may be left."""
    kept = rows if repo is None else rows.where(F.col("repo_id") == repo)
    return kept.limit(k) if k > 0 else kept


def keyword(c: Catalog, words: str, filters: O.Filters = O.Filters(), k: int = 10, language: str | None = None) -> DataFrame:
    k = k if k > 0 else retrieval.TOP
    out = hydrate(c, keyword_list(c, words, candidates(c, filters), k))
    return (out if language is None else out.where(X.strip_dot(F.col("language")) == language.removeprefix("."))).limit(k)


def grep(c: Catalog, contents: DataFrame, repo: int, pattern: str, pathspec: str | None = None, most_files: int = 10) -> DataFrame:
    """Matches at the repository's latest commit; ``contents`` holds commit_sha, path and content."""
    head = latest_commit(c, repo).select("commit_sha")
    return retrieval.grep(contents.join(head, "commit_sha", "left_semi"), pattern, pathspec, most_files)


def preview(matches: Column, shown: int = 5) -> Column:
    """The first matches as text, and how many more there are."""
    lines = F.transform(F.slice(matches, 1, shown), lambda m: F.concat(m["line"].cast("string"), F.lit(": "), F.substring(m["content"], 1, 200)))
    more = F.size(matches) - shown
    return F.concat(F.array_join(lines, "\n"), F.when(more > 0, F.concat(F.lit("\n"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def listing(c: Catalog, repo: int, pattern: str, page: int = 1, size: int = 20) -> DataFrame:
    head = latest_commit(c, repo).select("commit_sha")
    return retrieval.listing(c["git_commit_files"].join(head, "commit_sha", "left_semi"), pattern, page, size)


def read_lines(contents: DataFrame, path: str, spec: str = "", numbered: bool = False) -> DataFrame:
    return contents.where(F.col("path") == path).select("path", X.pick_lines(F.col("content"), X.parse_lines(spec), numbered).alias("content"))


def resolve(c: Catalog, wanted: DataFrame) -> DataFrame:
    """(repo, ref) with commit_sha: a commit of that very name, else a tag's, else a branch's; else null."""
    known = (c["git_commits"].select("repo_id", F.col("commit_sha").alias("name"), "commit_sha"), c["git_tags"].select("repo_id", "name", F.col("target_commit_sha").alias("commit_sha")), c["git_branches"].select("repo_id", "name", F.col("head_commit_sha").alias("commit_sha")))
    out, shas = wanted, []
    for n, table in enumerate(known):
        one = table.groupBy(F.col("repo_id").alias("repo"), F.col("name").alias("ref")).agg(F.min("commit_sha").alias(f"_sha{n}"))
        out, shas = out.join(one, ["repo", "ref"], "left"), [*shas, f"_sha{n}"]
    return out.withColumn("commit_sha", F.coalesce(*shas)).drop(*shas)


def read_uris(c: Catalog, contents: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, commit_sha, path, content) of file addresses: reference, content and lines in one plan.

    ``contents`` holds commit_sha, path and content. An address whose reference, file or lines are
    not there has no content.
    """
    parts = X.parse_file_uri(F.col("uri"))
    # only the address travels beside the keys of a join; its other parts are read from it again
    asked = uris.select("uri", parts["repo"].alias("repo"), parts["ref"].alias("ref"))
    if c.scope is not None:
        asked = asked.where(F.col("repo").isin(sorted(c.scope)) if c.scope else F.lit(False))
    known = resolve(c, asked).select("uri", "commit_sha", parts["path"].alias("path"))
    texts = contents.select("commit_sha", "path", F.col("content").alias("_text"))
    found = known.where("commit_sha IS NOT NULL").join(texts, ["commit_sha", "path"], "left")
    shown = X.pick_lines_by(F.col("_text"), parts["lines"], parts["line_numbers"]).alias("content")
    # an address whose reference is not known meets no text
    return found.select("uri", "commit_sha", "path", shown).unionByName(known.where("commit_sha IS NULL").select("uri", "commit_sha", "path", F.lit(None).cast("string").alias("content")))


def read_page(pages: DataFrame, page: int | None = None, lines: str = "", numbered: bool = False) -> DataFrame:
    """A page's text of documents (path, page, text), or without a page how many each has."""
    if page is None:
        return pages.groupBy("path").agg(F.max("page").alias("page_count"))
    if page < 1:
        raise ValueError("pages start at 1")
    return pages.where(F.col("page") == page).select("path", "page", X.pick_lines(F.col("text"), X.parse_lines(lines), numbered).alias("content"))


def read_raster(pictures: DataFrame, page: int) -> DataFrame:
    """A page's picture of documents (path, page, image) as base64."""
    if page < 1:
        raise ValueError("pages start at 1")
    return pictures.where(F.col("page") == page).select("path", "page", F.base64("image").alias("image"))


# --- documents for readers


def document(c: Catalog, repo: int, kind: str, subtype: str) -> DataFrame:
    """The texts of one kind at the latest commit, joined in order; empty ones do not count."""
    rows = _of_commits(c, latest_commit(c, repo)).where((F.col("type") == kind) & (F.col("subtype") == subtype) & (F.col("content") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("id", "content")))
    return rows.agg(F.array_join(F.transform(ordered, lambda r: r["content"]), "\n\n").alias("content"))


def wiki_page(c: Catalog, repo: int, path: str, prefix: str = "") -> str | None:
    """One page of the stored tree with its links rewritten."""
    row = _of_commits(c, latest_commit(c, repo)).where("subtype = 'wiki'").orderBy("id").limit(1).select("content").first()
    if row is None or (page := D.find_page(pages := D.parse_wiki(row["content"]), path)) is None:
        return None
    return D.rewrite_links(page.content, D.path_index(pages), prefix)


# --- status, pipelines


def status(c: Catalog, repo: int) -> DataFrame:
    """Task states of a repository with their parents and completion."""
    rows = c["task_status"].where((F.col("trackable_type") == "repository") & (F.col("trackable_id") == repo))
    parents = c["task_status"].select(F.col("id").alias("parent"), F.col("operation").alias("parent_operation"))
    return rows.join(parents, "parent", "left").withColumn("percent", R.completion_percent(F.col("current"), F.col("total"))).orderBy("created_at", "id")


def status_summary(c: Catalog, repo: int) -> DataFrame:
    rows = c["task_status"].where((F.col("trackable_type") == "repository") & (F.col("trackable_id") == repo)).withColumnRenamed("trackable_id", "repo_id")
    queued = c["tasks"].select(X.payload_number(F.col("payload"), "repository_id").alias("repo_id")).where(F.col("repo_id") == repo)
    return R.status_rollup(rows, ["repo_id"], queued)


def pipeline_steps(c: Catalog) -> DataFrame:
    """Pipelines with their steps and what each step waits for."""
    rows = c["pipelines"].withColumnRenamed("id", "pipeline_id").withColumnRenamed("name", "pipeline").join(c["pipeline_steps"], "pipeline_id").join(c["steps"].withColumnRenamed("id", "step_id"), "step_id")
    needs = c["step_dependencies"].groupBy("step_id").agg(F.sort_array(F.collect_set("depends_on_id")).alias("depends_on"))
    return rows.join(needs, "step_id", "left")


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """A page with its row numbers; only for pages, which are short."""
    return rows.withColumn("row", F.row_number().over(Window.orderBy(order)))


#: Endpoints by name, for registries and servers.
ENDPOINTS: dict[str, Callable] = {f.__name__: f for f in (repositories, find_repository, commits, latest_commit, commit_files, tags, commit_enrichments, repository_enrichments, commit_snippets, delete_enrichments, cleanup_old, search, semantic, keyword, grep, listing, read_lines, document, wiki_page, status, status_summary, pipeline_steps)}


# --- settings of repositories


SETTINGS = {"tracking": ("tracking_type", "tracking_name"), "chunking": ("chunk_size", "chunk_overlap", "min_chunk_size"), "pipeline": ("pipeline_id",)}
#: What a repository without settings of its own uses.
DEFAULTS = {"chunk_size": 1500, "chunk_overlap": 200, "min_chunk_size": 50}


def settings(c: Catalog, kind: str, repo: int | None = None) -> DataFrame:
    """One kind of settings of a repository, or of all that the scope sees, defaults filled in."""
    if repo is not None:
        c.check(repo)
    rows = c.repos() if repo is None else c.repos().where(F.col("id") == repo)
    return rows.select("id", *[F.coalesce(F.nullif(F.col(n), F.lit(0)), F.lit(DEFAULTS[n])).alias(n) if n in DEFAULTS else F.col(n) for n in SETTINGS[kind]])


def change_settings(c: Catalog, kind: str, repo: int, **values: object) -> DataFrame:
    """The repositories with new settings of one; chunk sizes must fit each other."""
    c.check(repo)
    if unknown := set(values) - set(SETTINGS[kind]):
        raise ValueError(f"no {kind} settings: {sorted(unknown)}")
    if kind == "chunking":
        size, overlap, least = (values.get(n, DEFAULTS[n]) for n in SETTINGS[kind])
        ChunkConfig(size, overlap, least)
    rows = c["git_repos"]
    return rows.withColumns({n: F.when(F.col("id") == repo, F.lit(v).cast(rows.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items()})


def rescan_all(c: Catalog) -> DataFrame:
    """Tasks that scan each repository's newest commit anew, in one scan of the tables."""
    newest = R.latest_per_key(c["git_commits"], ["repo_id"], F.desc("date"), F.col("commit_sha"))
    rows = newest.join(c.repos().select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    payload = F.to_json(F.struct(F.col("repo_id").alias("repository_id"), "commit_sha"))
    return rows.select(X.dedup_key(F.lit("commit.rescan"), payload).alias("dedup_key"), F.lit("commit.rescan").alias("type"), payload.alias("payload"))


# --- whole repositories


def commit_keys(c: Catalog, sha: str) -> dict[str, DataFrame]:
    """Of every table: the keys of what is known of a commit."""
    own = c["git_commits"].where(F.col("commit_sha") == sha).select("commit_sha")
    return enrichment_keys(c, _of_commits(c, [sha]).select("id")) | {"git_commit_files": own, "git_commits": own}


def rescan(c: Catalog, sha: str) -> dict[str, DataFrame]:
    """All tables without what is known of a commit, so that it is scanned anew."""
    return without(c, commit_keys(c, sha))


def repository_keys(c: Catalog, repo: int) -> dict[str, DataFrame]:
    """Of every table: the keys of a repository, its history, what was derived from it and its queued tasks."""
    c.check(repo)
    commits = c["git_commits"].where(F.col("repo_id") == repo)
    own = c["git_repos"].where(F.col("id") == repo).select("id")
    tasks = c["tasks"].where(X.payload_number(F.col("payload"), "repository_id") == repo).select("dedup_key")
    history = {name: own.select(F.col("id").alias("repo_id")) for name in ("git_commits", "git_branches", "git_tags")}
    return enrichment_keys(c, _of_commits(c, commits).select("id")) | {"git_commit_files": commits.select("commit_sha"), **history, "git_repos": own, "tasks": tasks}


def delete_repository(c: Catalog, repo: int) -> dict[str, DataFrame]:
    """All tables without a repository, its history, what was derived from it and its queued tasks."""
    return without(c, repository_keys(c, repo))


def add_repository(c: Catalog, url: str, number: int) -> tuple[DataFrame, bool]:
    """The repository of an address, and whether it is new; adding one twice changes nothing."""
    found = find_repository(c, url)
    if not found.isEmpty():
        return found, False
    row = c["git_repos"].sparkSession.createDataFrame([(number, url)], "id long, remote_uri string")
    fresh = row.withColumn("sanitized_remote_uri", X.sanitize_uri(F.col("remote_uri")))
    return c["git_repos"].limit(0).unionByName(fresh, allowMissingColumns=True), True


ENDPOINTS |= {f.__name__: f for f in (rescan, delete_repository, add_repository, simple_search, enrichments, enrichment, patch_enrichment, repository_ids, page_image_jobs, source_files, visual, resolve, read_uris, read_page, read_raster, settings, change_settings, rescan_all)}
