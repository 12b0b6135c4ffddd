"""The endpoints over the driver's tables: what a repository, commit, file and enrichment is there, and the SQL.

The stored tables are views of the driver's tables in SQL that Spark and DuckDB both run: customers are
repositories, orders commits, line items files, documents enrichments, events tasks and their states.
The expected result of a query is written in DuckDB SQL over the same views.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stemming import stem
from ..operators import mutations as M
from ..operators import options as O
from ..operators import relational as R
from ..session import shared_folder, ship_package
from ..sources import git
from ..sources.files import jsonapi_rows
from ..streaming import queue
from . import endpoints as N
from . import retrieval, sync
from .catalogue import ORACLES, QUERIES

_STATE = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'failed' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'started' ELSE 'completed' END ELSE 'completed' END"

VIEWS = {
    "git_repos": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 END AS pipeline_id, 'https://host/' || c_custkey AS sanitized_remote_uri, CASE WHEN c_custkey % 10 = 0 THEN 'https://up/' || (c_custkey + 1) END AS upstream_url, CASE WHEN c_custkey % 5 = 0 THEN 'branch' WHEN c_custkey % 5 = 1 THEN 'commit' ELSE '' END AS tracking_type, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN 'sha' || c_custkey ELSE '' END AS tracking_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(500 + c_custkey % 3 AS INT) ELSE 0 END AS chunk_size, CAST(0 AS INT) AS chunk_overlap, CAST(c_custkey % 60 AS INT) AS min_chunk_size, CASE WHEN c_custkey % 3 > 0 THEN 'clones/' || c_custkey END AS cloned_path, CASE WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' WHEN c_custkey % 3 = 2 THEN TIMESTAMP '2024-01-10 00:00:00' END AS last_scanned_at FROM customer",
    "git_commits": "SELECT CAST(o_orderkey AS STRING) AS commit_sha, o_custkey AS repo_id, o_orderdate AS date, o_orderpriority AS author FROM orders",
    "git_branches": "SELECT c_custkey AS repo_id, 'main' AS name, CAST(c_custkey AS STRING) AS head_commit_sha, c_custkey % 7 > 0 AS is_default FROM customer UNION ALL SELECT c_custkey, lower(c_mktsegment), CAST(c_custkey * 2 AS STRING), false FROM customer WHERE c_custkey % 2 = 0",
    "git_tags": "SELECT o_custkey AS repo_id, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey ELSE 'rc-' || o_orderkey END AS name, CAST(o_orderkey AS STRING) AS target_commit_sha FROM orders WHERE o_orderstatus = 'F'",
    "git_commit_files": "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey AS STRING) AS commit_sha, 'src/' || min(l_returnflag) || '/f' || l_linenumber || CASE WHEN min(l_linestatus) = 'O' THEN '.py' ELSE '.go' END AS path, CAST(min(l_partkey) AS STRING) AS blob_sha, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "enrichments_v2": "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN 'usage' ELSE 'development' END AS type, CASE WHEN doc_id % 5 = 4 THEN 'api_docs' WHEN doc_id % 5 = 3 THEN 'snippet_summary' WHEN doc_id % 5 = 2 THEN 'page_image' ELSE 'chunk' END AS subtype, CASE WHEN doc_id % 15 = 4 THEN '' ELSE text END AS content, lang AS language, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS created_at FROM documents",
    "enrichment_associations": "SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS enrichment_id, 'git_commits' AS entity_type, CAST(l_orderkey AS STRING) AS entity_id FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT 1000000000000 + l_orderkey * 10 + l_linenumber, min(l_partkey), 'git_commit_files', CAST(l_orderkey * 10 + l_linenumber AS STRING) FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber UNION ALL SELECT 2000000000000 + doc_id, doc_id, 'enrichments_v2', CAST(doc_id - doc_id % 5 AS STRING) FROM documents WHERE doc_id % 5 IN (3, 4) UNION ALL SELECT 3000000000000 + p_partkey * 2, p_partkey, 'git_repos', CAST(p_size AS STRING) FROM part UNION ALL SELECT 3000000000001 + p_partkey * 2, p_partkey, 'git_repos', CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE CAST(p_size + 1 AS STRING) END FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 4000000000000 + doc_id, doc_id, 'git_commit_files', 'not a number' FROM documents WHERE doc_id % 50 = 0",
    "source_locations": "SELECT doc_id AS enrichment_id, CAST(doc_id % 7 AS INT) AS page, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 40 + 1 END AS INT) AS start_line, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 40 + 9 END AS INT) AS end_line FROM documents WHERE doc_id % 4 > 0",
    "keyword_index": "SELECT CAST(doc_id AS STRING) AS snippet_id, text AS passage FROM documents WHERE doc_id % 5 < 2",
    "vector_index": "SELECT CAST(vec_id AS STRING) AS snippet_id, CASE WHEN vec_id % 5 = 2 THEN 'vision' ELSE 'code' END AS task, embedding FROM embeddings",
    "task_status": f"SELECT 'e' || event_id AS id, ts AS created_at, ts AS updated_at, CASE WHEN event_id % 2 = 0 THEN 'commit.' ELSE 'repository.' END || event_type AS operation, user_id AS trackable_id, 'repository' AS trackable_type, CASE WHEN event_id % 10 > 0 THEN 'e' || (event_id - event_id % 10) END AS parent, {_STATE} AS state, 'error ' || event_id AS error, CAST(event_id % 4 * 10 AS INT) AS total, CAST(event_id % 37 AS INT) AS current FROM events",
    "tasks": "SELECT event_id AS id, 'k' || event_id AS dedup_key, event_type AS type, '{\"repository_id\": ' || user_id || '}' AS payload, CAST(1000 + event_id % 7 * 500 AS INT) AS priority, ts AS created_at, ts AS updated_at FROM events WHERE event_type IN ('view', 'purchase')",
    "pipelines": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "steps": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'kind' || n_nationkey % 3 AS kind FROM nation",
    "pipeline_steps": "SELECT CAST(n_regionkey AS BIGINT) AS pipeline_id, CAST(n_nationkey AS BIGINT) AS step_id, 'all' AS join_type FROM nation",
    "step_dependencies": "SELECT CAST(a.n_nationkey AS BIGINT) AS step_id, CAST(b.n_nationkey AS BIGINT) AS depends_on_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey AND b.n_nationkey >= a.n_nationkey - 10",
    "file_contents": "SELECT CAST(l_orderkey AS STRING) AS commit_sha, 'src/' || min(l_returnflag) || '/f' || l_linenumber || CASE WHEN min(l_linestatus) = 'O' THEN '.py' ELSE '.go' END AS path, min(text) AS content FROM lineitem JOIN benchmark ON item_id = l_orderkey % 40 GROUP BY l_orderkey, l_linenumber",
}


def catalog(spark: SparkSession, sf_dir: str) -> N.Catalog:
    """The endpoints' tables as views of the files of a folder; a view that is not used is never read."""
    of_files = lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`"
    return N.Catalog({name: spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", of_files, sql)) for name, sql in VIEWS.items()}, extra={"spark": spark})


def endpoint(sql: str | None) -> Callable[[Callable[[N.Catalog], DataFrame]], Callable[[N.Catalog], DataFrame]]:
    """Register a function of the catalog with its SQL, before which the views that it names are put."""

    def register(fn: Callable[[N.Catalog], DataFrame]) -> Callable[[N.Catalog], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(catalog(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            used = [f"{name} AS ({view})" for name, view in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
            ORACLES[fn.__name__] = f"WITH RECURSIVE {', '.join(used)}, _ AS (SELECT 1) {sql}" if not sql.startswith("WITH ") else f"WITH RECURSIVE {', '.join(used)}, {sql[5:]}"
        return fn

    return register


# --- repositories, commits, files


@endpoint("""SELECT r.id AS repo_id, coalesce(b.n, 0) AS branch_count, coalesce(t.n, 0) AS tag_count, coalesce(k.n, 0) AS commit_count, d.name AS default_branch FROM git_repos r
LEFT JOIN (SELECT repo_id, count(*) AS n FROM git_branches GROUP BY 1) b ON b.repo_id = r.id LEFT JOIN (SELECT repo_id, count(*) AS n FROM git_tags GROUP BY 1) t ON t.repo_id = r.id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM git_commits GROUP BY 1) k ON k.repo_id = r.id LEFT JOIN (SELECT repo_id, min(name) AS name FROM git_branches WHERE is_default GROUP BY 1) d ON d.repo_id = r.id""")
def ep_repositories(c):
    return N.repositories(c).select("repo_id", "branch_count", "tag_count", "commit_count", "default_branch")


@endpoint("WITH u AS (SELECT sanitized_remote_uri AS url FROM git_repos UNION SELECT upstream_url FROM git_repos WHERE upstream_url IS NOT NULL UNION SELECT 'https://none/' || id FROM git_repos) SELECT url, coalesce((SELECT min(id) FROM git_repos r WHERE r.sanitized_remote_uri = url), (SELECT min(id) FROM git_repos r WHERE r.upstream_url = url)) AS id FROM u")
def ep_repository_by_url(c):
    """Every address, sanitized or upstream, and the repository it leads to."""
    repos = c["git_repos"]
    urls = repos.select(F.col("sanitized_remote_uri").alias("url")).union(repos.where("upstream_url IS NOT NULL").select("upstream_url")).union(repos.select(F.concat(F.lit("https://none/"), F.col("id").cast("string")))).distinct()
    return R.resolve_first(urls, "url", [(repos, "sanitized_remote_uri", "id"), (repos.where("upstream_url IS NOT NULL"), "upstream_url", "id")]).select("url", F.col("resolved").alias("id"))


@endpoint("SELECT commit_sha, author FROM git_commits WHERE repo_id = 7 ORDER BY commit_sha LIMIT 5 OFFSET 5")
def ep_commits(c):
    return N.commits(c, 7, page=2, size=5).select("commit_sha", "author")


@endpoint("SELECT commit_sha, path, size, blob_sha FROM git_commit_files WHERE commit_sha = '77' ORDER BY path LIMIT 20")
def ep_commit_files(c):
    return N.commit_files(c, "77").select("commit_sha", "path", "size", "blob_sha")


@endpoint("SELECT repo_id, name, regexp_matches(name, '^(v[0-9]|[0-9])') AS is_version FROM git_tags WHERE repo_id = 7 ORDER BY name LIMIT 20")
def ep_tags(c):
    return N.tags(c, 7).select("repo_id", "name", "is_version")


@endpoint("SELECT repo_id, commit_sha FROM git_commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY date DESC, commit_sha) = 1")
def ep_rescan_all(c):
    """A task for each repository's newest commit."""
    rows = N.rescan_all(c)
    return rows.select(X.payload_number(F.col("payload"), "repository_id").alias("repo_id"), F.get_json_object("payload", "$.commit_sha").alias("commit_sha"))


@endpoint("SELECT w.name || '@' || w.repo_id AS ref, CASE WHEN k.commit_sha IS NOT NULL THEN k.commit_sha WHEN t.target IS NOT NULL THEN t.target ELSE b.head END AS commit_sha FROM (SELECT repo_id, name FROM git_branches UNION SELECT repo_id, name FROM git_tags UNION SELECT repo_id, commit_sha FROM git_commits UNION SELECT id, 'nowhere' FROM git_repos) w LEFT JOIN git_commits k ON k.repo_id = w.repo_id AND k.commit_sha = w.name LEFT JOIN (SELECT repo_id AS r, name AS n, min(target_commit_sha) AS target FROM git_tags GROUP BY ALL) t ON t.r = w.repo_id AND t.n = w.name LEFT JOIN (SELECT repo_id AS r, name AS n, min(head_commit_sha) AS head FROM git_branches GROUP BY ALL) b ON b.r = w.repo_id AND b.n = w.name")
def ep_resolve_references(c):
    """Commits, tags, branches and unknown names of all repositories."""
    wanted = c["git_branches"].select("repo_id", "name").union(c["git_tags"].select("repo_id", "name")).union(c["git_commits"].select("repo_id", "commit_sha")).union(c["git_repos"].select("id", F.lit("nowhere"))).distinct()
    rows = N.resolve(c, wanted.select(F.col("repo_id").alias("repo"), F.col("name").alias("ref")))
    return rows.select(F.concat("ref", F.lit("@"), F.col("repo").cast("string")).alias("ref"), "commit_sha")


# --- enrichments


_OF_COMMIT = "SELECT enrichment_id FROM enrichment_associations WHERE entity_type = 'git_commits' AND entity_id"
_LINED = "nullif(l.page, 0) AS page, nullif(l.start_line, 0) AS start_line, nullif(l.end_line, 0) AS end_line"


@endpoint(f"SELECT e.id, e.subtype, {_LINED} FROM (SELECT * FROM enrichments_v2 WHERE id IN ({_OF_COMMIT} = '77')) e LEFT JOIN source_locations l ON l.enrichment_id = e.id ORDER BY e.id LIMIT 20")
def ep_commit_enrichments(c):
    return N.commit_enrichments(c, "77").select("id", "subtype", "page", "start_line", "end_line")


@endpoint(f"SELECT id, type FROM enrichments_v2 WHERE id IN ({_OF_COMMIT} IN (SELECT commit_sha FROM git_commits WHERE repo_id = 7 ORDER BY commit_sha LIMIT 4)) ORDER BY id LIMIT 10 OFFSET 2")
def ep_repository_enrichments(c):
    """Enrichments of the first commits of a repository, by SHA."""
    shas = c["git_commits"].where("repo_id = 7").orderBy("commit_sha").limit(4)
    return O.build(O.with_pagination(10, 2)).apply(N._of_commits(c, shas), key="id").select("id", "type")


@endpoint("SELECT e.id, e.type, nullif(l.start_line, 0) AS start_line FROM (SELECT * FROM enrichments_v2 WHERE type = 'usage' ORDER BY id LIMIT 15 OFFSET 15) e LEFT JOIN source_locations l ON l.enrichment_id = e.id")
def ep_enrichments(c):
    return N.enrichments(c, kind="usage", page=2, size=15).select("id", "type", "start_line")


@endpoint("SELECT id, CASE WHEN id = 7 THEN 'new' ELSE content END AS content FROM enrichments_v2")
def ep_patch_enrichment(c):
    return N.patch_enrichment(c, 7, "new").select("id", "content")


@endpoint("SELECT a.enrichment_id AS id, f.id AS file_id, f.path, f.commit_sha FROM enrichment_associations a JOIN git_commit_files f ON f.id = try_cast(a.entity_id AS BIGINT) WHERE a.entity_type = 'git_commit_files'")
def ep_source_files(c):
    return N.source_files(c).select("id", "file_id", "path", "commit_sha")


@endpoint(f"SELECT e.id, {_LINED} FROM enrichments_v2 e LEFT JOIN source_locations l ON l.enrichment_id = e.id")
def ep_source_locations(c):
    return N.with_lines(c, c["enrichments_v2"]).select("id", "page", "start_line", "end_line")


@endpoint("SELECT enrichment_id AS id, try_cast(entity_id AS BIGINT) AS repo_id FROM enrichment_associations WHERE entity_type = 'git_repos' AND try_cast(entity_id AS BIGINT) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY enrichment_id ORDER BY id DESC) = 1")
def ep_repository_ids(c):
    return N.repository_ids(c)


@endpoint("""SELECT e.id, count(x.child) AS n, string_agg(x.child || ':' || x.subtype, ',' ORDER BY x.child) AS related FROM enrichments_v2 e
JOIN (SELECT a.enrichment_id AS child, try_cast(a.entity_id AS BIGINT) AS id, r.subtype FROM enrichment_associations a JOIN enrichments_v2 r ON r.id = a.enrichment_id WHERE a.entity_type = 'enrichments_v2') x ON x.id = e.id
WHERE e.subtype = 'chunk' GROUP BY e.id""")
def ep_related(c):
    """Chunks with what was derived from them."""
    rows = N.with_related(c, c["enrichments_v2"].where("subtype = 'chunk'")).where("related IS NOT NULL")
    return rows.select("id", F.size("related").cast("long").alias("n"), F.array_join(F.transform("related", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["subtype"])), ",").alias("related"))


@endpoint(f"SELECT e.id, (SELECT count(*) FROM enrichment_associations a JOIN enrichments_v2 r ON r.id = a.enrichment_id WHERE a.entity_type = 'enrichments_v2' AND a.entity_id = e.id::VARCHAR) AS related FROM enrichments_v2 e WHERE subtype = 'chunk' AND id IN ({_OF_COMMIT} = '77')")
def ep_commit_snippets(c):
    return N.commit_snippets(c, "77").select("id", F.coalesce(F.size("related"), F.lit(0)).cast("long").alias("related"))


@endpoint("SELECT e.id, l.page, f.path, f.commit_sha FROM enrichments_v2 e JOIN source_locations l ON l.enrichment_id = e.id JOIN (SELECT a.enrichment_id, f.path, f.commit_sha FROM enrichment_associations a JOIN git_commit_files f ON f.id = try_cast(a.entity_id AS BIGINT) WHERE a.entity_type = 'git_commit_files' QUALIFY row_number() OVER (PARTITION BY a.enrichment_id ORDER BY a.id) = 1) f ON f.enrichment_id = e.id WHERE e.subtype = 'page_image'")
def ep_page_image_jobs(c):
    return N.page_image_jobs(c).select("id", "page", "path", "commit_sha")


@endpoint(f"SELECT string_agg(content, chr(10) || chr(10) ORDER BY id) AS content FROM enrichments_v2 WHERE type = 'usage' AND subtype = 'api_docs' AND content <> '' AND id IN ({_OF_COMMIT} = (SELECT commit_sha FROM git_commits WHERE repo_id = 7 ORDER BY date DESC, commit_sha LIMIT 1))")
def ep_document(c):
    """The texts of one kind at the newest commit, empty ones left out."""
    return N.document(c, 7, "usage", "api_docs").select(F.nullif("content", F.lit("")).alias("content"))


# --- search


_IDS = "SELECT id FROM enrichments_v2 WHERE"


@endpoint(f"{_IDS} id IN ({_OF_COMMIT} IN ('77', '78', '140', '500'))")
def ep_filter_commits(c):
    return N.candidates(c, O.Filters(commit_shas=("77", "78", "140", "500"))).select("id")


@endpoint(f"{_IDS} language IN ('de', 'fr') AND subtype IN ('chunk') AND id IN (SELECT a.enrichment_id FROM enrichment_associations a JOIN git_commits k ON k.commit_sha = a.entity_id WHERE a.entity_type = 'git_commits' AND k.repo_id IN (3, 7, 11, 20, 60))")
def ep_filter_repositories(c):
    return N.candidates(c, O.Filters(languages=("de", "fr"), subtypes=("chunk",), source_repos=(3, 7, 11, 20, 60))).select("id")


@endpoint(r"""WITH a AS MATERIALIZED (SELECT enrichment_id, entity_type, entity_id, CASE WHEN entity_type = 'git_commit_files' THEN try_cast(entity_id AS BIGINT) END AS file_id FROM enrichment_associations),
w AS (SELECT DISTINCT a.enrichment_id AS id FROM a JOIN git_commits k ON k.commit_sha = a.entity_id WHERE a.entity_type = 'git_commits' AND k.author = '1-URGENT'),
p AS (SELECT DISTINCT a.enrichment_id AS id FROM a JOIN git_commit_files f ON f.id = a.file_id WHERE regexp_matches(f.path, '^src/[^/]*/f[^/]*\.py$'))
SELECT e.id FROM enrichments_v2 e JOIN w ON w.id = e.id JOIN p ON p.id = e.id WHERE e.created_at >= TIMESTAMP '2024-02-01'""")
def ep_filter_authors_paths(c):
    return N.candidates(c, O.Filters(authors=("1-URGENT",), file_paths=("src/*/f*.py",), created_after=dt.datetime(2024, 2, 1))).select("id")


@endpoint("SELECT h.enrichment_id, h.line, s.start_line, s.end_line FROM (SELECT id AS enrichment_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM enrichments_v2) h JOIN source_locations s ON s.enrichment_id = h.enrichment_id AND h.line BETWEEN s.start_line AND s.end_line WHERE regexp_matches(h.text, 'tion|the')")
def ep_hits_in_ranges(c):
    """Lines that match a pattern, with the stored line ranges that hold them."""
    found = retrieval.matching_lines(c["enrichments_v2"].select("id", "content"), "tion|the", path="id").select(F.col("id").alias("enrichment_id"), F.col("line").cast("int").alias("line"))
    ranges = c["source_locations"].select("enrichment_id", "start_line", "end_line")
    return R.interval_join(found, ranges, ["enrichment_id"], "line", "line", "start_line", "end_line").select("enrichment_id", "line", "start_line", "end_line")


@endpoint(f"{_IDS} id IN (SELECT a.enrichment_id FROM enrichment_associations a JOIN git_commits k ON k.commit_sha = a.entity_id WHERE a.entity_type = 'git_commits' AND k.repo_id IN (7, 9))")
def ep_scope(c):
    """A search asks for repositories 7, 8 and 9, but only 7, 9 and 30 are allowed."""
    return N.candidates(c.scoped([7, 9, 30]), O.Filters(source_repos=(7, 8, 9))).select("id")


_FIRST_FILE = "SELECT a.enrichment_id, f.path, f.commit_sha FROM enrichment_associations a JOIN git_commit_files f ON f.id = try_cast(a.entity_id AS BIGINT) WHERE a.entity_type = 'git_commit_files' QUALIFY row_number() OVER (PARTITION BY a.enrichment_id ORDER BY a.id) = 1"
_HYDRATED = f"""f AS ({_FIRST_FILE}), h AS (SELECT e.id, r.score, e.subtype, f.path, k.repo_id, g.sanitized_remote_uri AS remote, nullif(l.start_line, 0) AS start_line, nullif(l.page, 0) AS page, CASE WHEN f.path IS NOT NULL AND k.repo_id IS NOT NULL THEN 'file://' || k.repo_id || '/' || f.commit_sha || '/' || f.path END AS base, nullif(l.end_line, 0) AS end_line
FROM r JOIN enrichments_v2 e ON e.id = try_cast(r.id AS BIGINT) LEFT JOIN f ON f.enrichment_id = e.id LEFT JOIN git_commits k ON k.commit_sha = f.commit_sha LEFT JOIN git_repos g ON g.id = k.repo_id LEFT JOIN source_locations l ON l.enrichment_id = e.id)"""


@endpoint(f"WITH r AS (SELECT snippet_id AS id, embedding[1]::DOUBLE AS score FROM vector_index UNION ALL SELECT 'not a number', 1.0), {_HYDRATED} SELECT id, round(score, 6) AS score, path, repo_id, remote, start_line, CASE WHEN coalesce(start_line, 0) > 0 THEN base || '?lines=L' || start_line || '-L' || end_line ELSE base END AS uri FROM h")
def ep_hydrate(c):
    """Every vector's first number as a score: rows with their file, repository, lines and link; ids that are no numbers go."""
    scores = c["vector_index"].select(F.col("snippet_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("score"))
    odd = c["vector_index"].limit(1).select(F.lit("not a number").alias("id"), F.lit(1.0).alias("score"))
    rows = N.hydrate(c, scores.unionByName(odd))
    return rows.select("id", F.round("score", 6).alias("score"), "path", "repo_id", F.col("sanitized_remote_uri").alias("remote"), "start_line", "uri")


@endpoint("SELECT e.id FROM enrichments_v2 e JOIN vector_index v ON try_cast(v.snippet_id AS BIGINT) = e.id ORDER BY CASE WHEN e.id % 3 = 0 THEN NULL ELSE round(v.embedding[1]::DOUBLE, 2) END DESC NULLS LAST, e.id LIMIT 9")
def ep_hydrate_order(c):
    """Results come by score, those without one last, equal ones by id."""
    score = F.when(F.col("snippet_id").cast("long") % 3 > 0, F.round(F.element_at("embedding", 1).cast("double"), 2))
    return N.hydrate(c, c["vector_index"].select(F.col("snippet_id").alias("id"), score.alias("score"))).limit(9).select("id")


@endpoint("SELECT repo_id, max(name) AS name FROM git_tags WHERE regexp_matches(name, '^(v[0-9]|[0-9])') GROUP BY repo_id")
def ep_latest_versions(c):
    """The last version tag of each repository; without dates, by name."""
    tags = c["git_tags"].select("repo_id", "name", X.is_version_tag(F.col("name")).alias("is_version"), F.lit(None).cast("timestamp").alias("tagged_at"))
    return git.latest_version(tags)


@endpoint(f"WITH r AS (SELECT snippet_id AS id, embedding[1]::DOUBLE AS score FROM vector_index), {_HYDRATED} SELECT id, path FROM h WHERE path IS NOT NULL AND repo_id % 2 = 0")
def ep_hydrate_files(c):
    """Only results that stand in a file, and of these the ones of even repositories."""
    scores = c["vector_index"].select(F.col("snippet_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("score"))
    return N.hydrate(c, scores, with_file_only=True).where("repo_id % 2 = 0").select("id", "path")


_NEAR = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM vector_index WHERE snippet_id = '7'))"


def _vector(c: N.Catalog, snippet: str) -> list[float]:
    return c["vector_index"].where(F.col("snippet_id") == snippet).first()["embedding"]


@endpoint(f"WITH r AS (SELECT snippet_id AS id, {_NEAR} AS score FROM vector_index WHERE task = 'code' AND try_cast(snippet_id AS BIGINT) IN ({_IDS} language IN ('en', 'de')) ORDER BY 2 DESC, 1 LIMIT 12), {_HYDRATED} SELECT id, round(score, 6) AS score, path FROM h")
def ep_semantic(c):
    return N.semantic(c, _vector(c, "7"), O.Filters(languages=("en", "de")), k=12).select("id", F.round("score", 6).alias("score"), "path")


@endpoint(f"WITH r AS (SELECT snippet_id AS id, {_NEAR} AS score FROM vector_index WHERE task = 'vision' AND try_cast(snippet_id AS BIGINT) IN (SELECT id FROM enrichments_v2) ORDER BY 2 DESC, 1 LIMIT 10), {_HYDRATED} SELECT id, round(score, 6) AS score, base || CASE WHEN coalesce(page, 0) > 0 THEN '?page=' || page || '&mode=raster' ELSE '?mode=raster' END AS uri FROM h")
def ep_visual(c):
    return N.visual(c, _vector(c, "7"), k=10).select("id", F.round("score", 6).alias("score"), "uri")


@endpoint(f"WITH r AS (SELECT snippet_id AS id, {_NEAR} AS score FROM vector_index WHERE task = 'code' AND try_cast(snippet_id AS BIGINT) IN (SELECT id FROM enrichments_v2) ORDER BY 2 DESC, 1 LIMIT 30), {_HYDRATED} SELECT id FROM h WHERE repo_id % 3 = 0 ORDER BY score DESC, id LIMIT 5")
def ep_post_filter(c):
    """A filter on the repository after the search's limit, then the cap of the request."""
    found = N.semantic(c, _vector(c, "7"), k=30).where("repo_id % 3 = 0")
    return N.in_repository(found, None, 5).select("id")


_TOKENS = "SELECT snippet_id, regexp_extract_all(translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+|[^\\x00-\\x7f]+') AS t FROM keyword_index"


def _words(word: str) -> str:
    """A SQL list of the words that the phrase stemmer takes for this one."""
    ends = ("", "s", "es", "e", "ed", "ing", "ings", "ely", "ly", "er", "ers", "ness", "al", "ion", "ies")
    return ", ".join(f"'{w}'" for w in sorted({root + e for root in (word, word[:-1]) for e in ends}) if stem(w) == stem(word))


_PHRASE = f"""d AS ({_TOKENS}), p AS (SELECT snippet_id, unnest(t) AS term, generate_subscripts(t, 1) AS i, len(t) AS dl FROM d), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
m AS (SELECT a.snippet_id, any_value(a.dl) AS dl, count(*) AS tf FROM p a JOIN p b ON a.snippet_id = b.snippet_id AND b.i = a.i + 1 WHERE a.term IN ({_words("of")}) AND b.term IN ({_words("the")}) GROUP BY 1), q AS (SELECT count(*) AS df FROM m),
w AS (SELECT snippet_id AS id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM m, q, s)"""


@endpoint(f"WITH {_PHRASE}, r AS (SELECT * FROM w WHERE try_cast(id AS BIGINT) IN ({_IDS} language = 'en') ORDER BY score DESC, id LIMIT 8), {_HYDRATED} SELECT id, round(score, 6) AS score, path FROM h")
def ep_keyword(c):
    """A phrase among English entries; frequencies are those of all entries. The SQL lists the words of each stem."""
    return N.keyword(c, "of the", O.Filters(languages=("en",)), k=8).select("id", F.round("score", 6).alias("score"), "path")


@endpoint(f"""WITH {_PHRASE}, k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM w QUALIFY rank < 20), v AS (SELECT snippet_id AS id, row_number() OVER (ORDER BY {_NEAR} DESC, snippet_id) - 1 AS rank FROM vector_index WHERE task = 'code' AND try_cast(snippet_id AS BIGINT) IN (SELECT id FROM enrichments_v2) QUALIFY rank < 20),
r AS (SELECT id, sum(1 / (60.0 + rank)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10), {_HYDRATED} SELECT id, round(score, 9) AS score, path FROM h""")
def ep_search(c):
    """Hybrid search: one vector list and one keyword list, fused and hydrated."""
    return N.search(c, code=_vector(c, "7"), keywords=["of the"], k=10).select("id", F.round("score", 9).alias("score"), "path")


# --- lines, listings, contents


@endpoint("""WITH l AS (SELECT commit_sha, path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM file_contents WHERE commit_sha = (SELECT commit_sha FROM git_commits WHERE repo_id = 7 ORDER BY date DESC, commit_sha LIMIT 1)),
m AS (SELECT * FROM l WHERE regexp_matches(content, '[aeiou]{2}')), g AS (SELECT path, min(line) AS first, count(*) AS n, list(line::VARCHAR || ': ' || substr(content, 1, 200) ORDER BY line) AS shown FROM m GROUP BY path)
SELECT path, n, array_to_string(shown[1:5], chr(10)) || CASE WHEN n > 5 THEN chr(10) || (n - 5) || ' more' ELSE '' END AS preview FROM g ORDER BY path LIMIT 10""")
def ep_grep(c):
    """Matches at the newest commit by file, with a preview of the first five."""
    found = N.grep(c, c["file_contents"], 7, "[aeiou]{2}")
    return found.select("path", F.size("matches").cast("long").alias("n"), N.preview(F.col("matches")).alias("preview"))


@endpoint("SELECT path FROM git_commit_files WHERE commit_sha = (SELECT commit_sha FROM git_commits WHERE repo_id = 7 ORDER BY date DESC, commit_sha LIMIT 1) AND regexp_matches(path, '^(?:[^/]*/)*[^/]*\\.(py|go)$') ORDER BY path LIMIT 20")
def ep_listing(c):
    return N.listing(c, 7, "**/*.*").select("path")


@endpoint("""WITH u AS (SELECT k.repo_id, f.commit_sha, f.path, f.content, string_split(f.content, chr(10)) AS a FROM file_contents f JOIN git_commits k USING (commit_sha))
SELECT 'file://' || repo_id || '/' || commit_sha || '/' || path || '?lines=L2-L3,L6&line_numbers=true' AS uri, commit_sha, array_to_string(CASE WHEN len(a) >= 2 THEN [i || chr(9) || a[i] FOR i IN generate_series(2, least(3, len(a)))] ELSE [] END || CASE WHEN len(a) >= 6 THEN ['...', '6' || chr(9) || a[6]] ELSE [] END, chr(10)) AS content FROM u
UNION ALL SELECT 'file://' || repo_id || '/' || commit_sha || '/' || path, commit_sha, content FROM u
UNION ALL SELECT 'file://' || repo_id || '/nowhere/' || path || '?lines=L1', NULL, NULL FROM u""")
def ep_read_uris(c):
    """Contents of all addresses: some lines with numbers, whole files, and references that are not known."""
    files = c["file_contents"].join(c["git_commits"].select("commit_sha", "repo_id"), "commit_sha")
    base = F.concat(F.lit("file://"), F.col("repo_id").cast("string"), F.lit("/"))
    known = F.concat(base, "commit_sha", F.lit("/"), "path")
    uris = F.explode(F.array(F.concat(known, F.lit("?lines=L2-L3,L6&line_numbers=true")), known, F.concat(base, F.lit("nowhere/"), "path", F.lit("?lines=L1"))))
    return N.read_uris(c, c["file_contents"], files.select(uris.alias("uri"))).select("uri", "commit_sha", "content")


@endpoint("SELECT to_json({type: 'repository', id: id::VARCHAR, attributes: {url: sanitized_remote_uri, pipeline_id: pipeline_id}})::VARCHAR AS value FROM git_repos WHERE pipeline_id IS NOT NULL")
def ep_jsonapi(c):
    rows = c["git_repos"].where("pipeline_id IS NOT NULL").select("id", F.col("sanitized_remote_uri").alias("url"), "pipeline_id")
    return jsonapi_rows(rows, "repository")


# --- settings, pipelines, states


@endpoint("SELECT id, CASE WHEN chunk_size = 0 THEN 1500 ELSE chunk_size END AS chunk_size, 200 AS chunk_overlap, CASE WHEN min_chunk_size = 0 THEN 50 ELSE min_chunk_size END AS min_chunk_size FROM git_repos")
def ep_chunking_settings(c):
    return N.settings(c, "chunking")


@endpoint("SELECT id, CASE WHEN id = 7 THEN 'commit' ELSE tracking_type END AS tracking_type, CASE WHEN id = 7 THEN 'abc' ELSE tracking_name END AS tracking_name FROM git_repos")
def ep_change_tracking(c):
    return N.change_settings(c, "tracking", 7, tracking_type="commit", tracking_name="abc").select("id", "tracking_type", "tracking_name")


@endpoint("SELECT p.name AS pipeline, s.name AS step, (SELECT string_agg(depends_on_id::VARCHAR, ',' ORDER BY depends_on_id) FROM step_dependencies d WHERE d.step_id = s.id) AS depends_on FROM pipelines p JOIN pipeline_steps x ON x.pipeline_id = p.id JOIN steps s ON s.id = x.step_id")
def ep_pipeline_steps(c):
    return N.pipeline_steps(c).select("pipeline", F.col("name").alias("step"), F.array_join(F.transform("depends_on", lambda d: d.cast("string")), ",").alias("depends_on"))


@endpoint("SELECT s.id, s.state, p.operation AS parent_operation, CASE WHEN s.total = 0 THEN 0.0 ELSE round(least(greatest(s.current * 100.0 / s.total, 0), 100), 6) END AS percent FROM task_status s LEFT JOIN task_status p ON p.id = s.parent WHERE s.trackable_id = 7 AND s.trackable_type = 'repository'")
def ep_status(c):
    return N.status(c, 7).select("id", "state", "parent_operation", F.round("percent", 6).alias("percent"))


@endpoint("""WITH q AS (SELECT (payload::JSON ->> '$.repository_id')::BIGINT AS id, count(*) AS n FROM tasks GROUP BY 1), a AS (SELECT trackable_id AS id, count(*) FILTER (state IN ('started', 'in_progress')) AS active, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('completed', 'skipped')) AS done FROM task_status WHERE id::VARCHAR LIKE 'e%0' GROUP BY 1)
SELECT coalesce(a.id, q.id) AS id, CASE WHEN coalesce(active, 0) > 0 OR coalesce(q.n, 0) > 0 THEN 'in_progress' WHEN failed > 0 AND done > failed THEN 'completed_with_errors' WHEN failed > 0 THEN 'failed' WHEN done > 0 THEN 'completed' ELSE 'pending' END AS status FROM a FULL JOIN q ON q.id = a.id""")
def ep_status_summary(c):
    """All repositories: the states of some of their tasks, and what waits for them."""
    rows = c["task_status"].where("id LIKE 'e%0'").withColumnRenamed("id", "task").withColumnRenamed("trackable_id", "id")
    return R.status_rollup(rows, ["id"], c["tasks"].select(X.payload_number(F.col("payload"), "repository_id").alias("id"))).select("id", "status")


@endpoint("SELECT id, operation LIKE 'repository.%' AS of_repository, operation LIKE 'commit.%' AS of_commit FROM task_status WHERE state IN ('started', 'in_progress') AND trackable_type = 'repository' AND trackable_id = 8")
def ep_active_tasks(c):
    rows = O.build(O.with_active_state(), O.with_trackable("repository", 8)).apply(c["task_status"])
    return rows.select("id", X.is_repository_operation(F.col("operation")).alias("of_repository"), X.is_commit_operation(F.col("operation")).alias("of_commit"))


# --- the queue


@endpoint("WITH h AS (SELECT dedup_key FROM tasks ORDER BY priority DESC, created_at, dedup_key LIMIT 1) SELECT dedup_key, dedup_key IN (SELECT dedup_key FROM h) AS taken FROM tasks")
def ep_dequeue(c):
    head, rest = queue.dequeue(c["tasks"])
    return head.select("dedup_key", F.lit(True).alias("taken")).union(rest.select("dedup_key", F.lit(False)))


@endpoint("SELECT dedup_key, priority FROM tasks WHERE type = 'view' ORDER BY priority DESC, created_at, dedup_key LIMIT 1")
def ep_dequeue_operation(c):
    return queue.dequeue(c["tasks"], "view")[0].select("dedup_key", "priority")


@endpoint("SELECT dedup_key FROM (SELECT * FROM tasks ORDER BY priority DESC, created_at, dedup_key LIMIT 20 OFFSET 10) WHERE type = 'purchase'")
def ep_queue_page(c):
    """The operation is filtered after paging."""
    return queue.page(c["tasks"], "purchase", 20, 10).select("dedup_key")


@endpoint("SELECT dedup_key, CASE WHEN dedup_key = 'k4' THEN 10000 ELSE priority END AS priority FROM tasks WHERE (payload::JSON ->> '$.repository_id')::BIGINT <> 7")
def ep_queue_drain(c):
    """One task gets another priority, those of a repository go."""
    return queue.drain(queue.reprioritise(c["tasks"], "k4", 10_000), 7).select("dedup_key", "priority")


@endpoint("SELECT dedup_key, max(priority) FILTER (fresh) AS fresh_priority, coalesce(max(priority) FILTER (fresh), max(priority)) AS priority FROM (SELECT dedup_key, priority, false AS fresh FROM tasks UNION ALL SELECT 'k' || id * 3, 9999, true FROM tasks) GROUP BY 1")
def ep_enqueue(c):
    """Tasks that are queued already only get the new priority."""
    tasks = c["tasks"]
    fresh = tasks.select(F.concat(F.lit("k"), (F.col("id") * 3).cast("string")).alias("dedup_key"), "type", "payload", F.lit(9999).alias("priority"), "created_at", "updated_at")
    out = queue.enqueue(tasks, fresh)
    return out.select("dedup_key", F.when(F.col("priority") == 9999, 9999).alias("fresh_priority"), "priority")


@endpoint("SELECT id FROM git_repos WHERE last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '2024-01-08'")
def ep_due(c):
    return queue.due(c["git_repos"], dt.datetime(2024, 1, 10), dt.timedelta(days=2)).select("id")


@endpoint("""WITH b AS (SELECT repo_id, name, head_commit_sha, is_default, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS i FROM git_branches)
SELECT r.id AS repo_id, coalesce(CASE WHEN tracking_type = 'branch' THEN (SELECT min(head_commit_sha) FROM b WHERE b.repo_id = r.id AND b.name = r.tracking_name) WHEN tracking_type = 'commit' THEN tracking_name END, (SELECT min(head_commit_sha) FROM b WHERE b.repo_id = r.id AND is_default), (SELECT head_commit_sha FROM b WHERE b.repo_id = r.id AND i = 1)) AS commit_sha FROM git_repos r""")
def ep_choose_commits(c):
    """What a sync scans in each repository: the tracked branch or commit, else the default branch, else any."""
    return sync.chosen_commits(c["git_repos"], c["git_branches"]).select("repo_id", "commit_sha")


@endpoint("""WITH o AS (SELECT 'commit.scan' AS type, 0 AS i UNION ALL SELECT 'commit.chunks', 1), t AS (SELECT k.repo_id, k.commit_sha FROM git_commits k WHERE k.commit_sha IN ('77', '78', '140'))
SELECT type || ':' || commit_sha || ':' || repo_id AS dedup_key, 2000 + 10 * (2 - i) AS priority FROM t, o""")
def ep_enqueue_operations(c):
    """The operations of a pipeline for some commits, with falling priorities."""
    targets = c["git_commits"].where(F.col("commit_sha").isin("77", "78", "140")).select("repo_id", "commit_sha")
    return sync.operation_tasks(targets, ["commit.scan", "commit.chunks"]).select("dedup_key", "priority")


@endpoint("SELECT id AS repo_id FROM git_repos WHERE cloned_path IS NULL")
def ep_to_clone(c):
    """Repositories without a working copy; others are skipped."""
    return sync.to_clone(c["git_repos"]).select("repo_id")


@endpoint("WITH w AS (SELECT CAST(o AS VARCHAR) AS commit_sha FROM (SELECT (commit_sha::BIGINT) * 2 AS o FROM git_commits)) SELECT commit_sha FROM w WHERE commit_sha NOT IN (SELECT commit_sha FROM git_commits)")
def ep_to_scan(c):
    """Commits that are wanted but not there yet."""
    wanted = c["git_commits"].select("repo_id", (F.col("commit_sha").cast("long") * 2).cast("string").alias("commit_sha"))
    return sync.to_scan(wanted, c["git_commits"].drop("repo_id")).select("commit_sha")


@endpoint("SELECT a.entity_id AS commit_sha, count(*) AS n FROM (SELECT DISTINCT e.id, a.entity_id FROM enrichments_v2 e JOIN enrichment_associations a ON a.enrichment_id = e.id AND a.entity_type = 'git_commits' WHERE e.subtype = 'chunk' AND e.content <> '' AND e.id::VARCHAR NOT IN (SELECT snippet_id FROM keyword_index WHERE snippet_id::BIGINT % 2 = 0)) a GROUP BY 1")
def ep_to_index(c):
    """By commit, how many chunks the keyword index lacks; half of them are there."""
    known = c["keyword_index"].where("CAST(snippet_id AS BIGINT) % 2 = 0")
    return sync.to_index(c, known, "chunk").groupBy("commit_sha").agg(F.count("*").alias("n"))


# --- changes


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return R.reduce_union([t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()])


def _left(ids: str) -> str:
    return f"""SELECT 'enrichments_v2' AS name, count(*) AS n FROM enrichments_v2 WHERE id NOT IN ({ids}) UNION ALL SELECT 'enrichment_associations', count(*) FROM enrichment_associations WHERE enrichment_id NOT IN ({ids})
UNION ALL SELECT 'source_locations', count(*) FROM source_locations WHERE enrichment_id NOT IN ({ids}) UNION ALL SELECT 'keyword_index', count(*) FROM keyword_index WHERE snippet_id::BIGINT NOT IN ({ids}) UNION ALL SELECT 'vector_index', count(*) FROM vector_index WHERE snippet_id::BIGINT NOT IN ({ids})"""


@endpoint(_left("SELECT id FROM enrichments_v2 WHERE type = 'usage'"))
def ep_delete_enrichments(c):
    return _sizes(N.delete_enrichments(c, c["enrichments_v2"].where("type = 'usage'").select("id")))


@endpoint(_left(f"SELECT id FROM enrichments_v2 WHERE id IN ({_OF_COMMIT} = '77')") + " UNION ALL SELECT 'git_commit_files', count(*) FROM git_commit_files WHERE commit_sha <> '77' UNION ALL SELECT 'git_commits', count(*) FROM git_commits WHERE commit_sha <> '77'")
def ep_rescan(c):
    return _sizes(N.rescan(c, "77"))


_OF_REPO = f"SELECT id FROM enrichments_v2 WHERE id IN ({_OF_COMMIT} IN (SELECT commit_sha FROM git_commits WHERE repo_id = 7))"


@endpoint(_left(_OF_REPO) + " UNION ALL SELECT 'git_commit_files', count(*) FROM git_commit_files WHERE commit_sha NOT IN (SELECT commit_sha FROM git_commits WHERE repo_id = 7) UNION ALL SELECT 'git_commits', count(*) FROM git_commits WHERE repo_id <> 7 UNION ALL SELECT 'git_branches', count(*) FROM git_branches WHERE repo_id <> 7 UNION ALL SELECT 'git_tags', count(*) FROM git_tags WHERE repo_id <> 7 UNION ALL SELECT 'git_repos', count(*) FROM git_repos WHERE id <> 7 UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE (payload::JSON ->> '$.repository_id')::BIGINT <> 7")
def ep_delete_repository(c):
    return _sizes(N.delete_repository(c, 7))


def _erased(c, keys):
    """The sizes of stored tables after a delete that writes keys alone."""
    spark = c["git_repos"].sparkSession
    store = M.TableStore(spark, f"{shared_folder(spark)}/lodestone-catalog-{uuid.uuid4().hex}")
    store.transaction({name: c[name] for name in keys})
    N.erase(store, keys)
    return _sizes({name: store.read(name) for name in keys})


@endpoint(_left("SELECT id FROM enrichments_v2 WHERE type = 'usage'"))
def ep_erase_enrichments(c):
    return _erased(c, N.enrichment_keys(c, c["enrichments_v2"].where("type = 'usage'").select("id")))


@endpoint(_left(_OF_REPO) + " UNION ALL SELECT 'git_commit_files', count(*) FROM git_commit_files WHERE commit_sha NOT IN (SELECT commit_sha FROM git_commits WHERE repo_id = 7) UNION ALL SELECT 'git_commits', count(*) FROM git_commits WHERE repo_id <> 7 UNION ALL SELECT 'git_branches', count(*) FROM git_branches WHERE repo_id <> 7 UNION ALL SELECT 'git_tags', count(*) FROM git_tags WHERE repo_id <> 7 UNION ALL SELECT 'git_repos', count(*) FROM git_repos WHERE id <> 7 UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE (payload::JSON ->> '$.repository_id')::BIGINT <> 7")
def ep_erase_repository(c):
    return _erased(c, N.repository_keys(c, 7))


@endpoint(_left(f"SELECT id FROM enrichments_v2 WHERE subtype = 'chunk' AND id IN ({_OF_COMMIT} IN (SELECT commit_sha FROM git_commits WHERE repo_id = 7 AND commit_sha <> (SELECT max(commit_sha) FROM git_commits WHERE repo_id = 7))) AND id NOT IN ({_OF_COMMIT} = (SELECT max(commit_sha) FROM git_commits WHERE repo_id = 7))"))
def ep_cleanup_old(c):
    """What older commits left of a kind, once the newest is processed."""
    newest = c["git_commits"].where("repo_id = 7").agg(F.max("commit_sha")).first()[0]
    return _sizes(N.cleanup_old(c, 7, newest, "development", "chunk"))


@endpoint("SELECT id, CASE WHEN id % 6 = 0 THEN 'changed' ELSE tracking_type END AS tracking_type, sanitized_remote_uri FROM git_repos UNION ALL SELECT id + 1000000000, 'changed', NULL FROM git_repos WHERE id % 300 = 0")
def ep_upsert_columns(c):
    """An upsert that changes one column of the rows that are there."""
    repos = c["git_repos"].select("id", "tracking_type", "sanitized_remote_uri")
    changes = repos.where("id % 6 = 0").select("id", F.lit("changed").alias("tracking_type")).union(repos.where("id % 300 = 0").select(F.col("id") + 1000000000, F.lit("changed")))
    return M.upsert(repos, changes, ["id"], update=["tracking_type"])


@endpoint("SELECT id FROM git_repos WHERE upstream_url IS NULL OR upstream_url NOT LIKE '%1'")
def ep_delete_where(c):
    """A condition that is null for a row does not delete it."""
    return M.delete_where(c["git_repos"], F.col("upstream_url").like("%1")).select("id")
