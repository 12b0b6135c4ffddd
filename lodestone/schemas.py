"""Table schemas and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "BINARY": T.BinaryType(), "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType())}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "git_repos": "id BIGINT, pipeline_id BIGINT, sanitized_remote_uri STRING, remote_uri STRING, upstream_url STRING, cloned_path STRING, last_scanned_at TIMESTAMP, num_commits INT, num_branches INT, num_tags INT, tracking_type STRING, tracking_name STRING, chunk_size INT, chunk_overlap INT, min_chunk_size INT, created_at TIMESTAMP, updated_at TIMESTAMP",
        "git_commits": "commit_sha STRING, repo_id BIGINT, date TIMESTAMP, message STRING, parent_commit_sha STRING, author STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
        "git_branches": "repo_id BIGINT, name STRING, head_commit_sha STRING, is_default BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
        "git_tags": "repo_id BIGINT, name STRING, target_commit_sha STRING, message STRING, tagger_name STRING, tagger_email STRING, tagged_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
        "git_commit_files": "id BIGINT, commit_sha STRING, path STRING, blob_sha STRING, mime_type STRING, extension STRING, size BIGINT, created_at TIMESTAMP",
        "enrichments_v2": "id BIGINT, type STRING, subtype STRING, content STRING, language STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
        "enrichment_associations": "id BIGINT, enrichment_id BIGINT, entity_type STRING, entity_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
        "source_locations": "id BIGINT, enrichment_id BIGINT, page INT, start_line INT, end_line INT",
        "keyword_index": "snippet_id STRING, passage STRING",
        "vector_index": "snippet_id STRING, task STRING, embedding ARRAY<DOUBLE>",
        "tasks": "id BIGINT, dedup_key STRING, type STRING, payload STRING, priority INT, created_at TIMESTAMP, updated_at TIMESTAMP",
        "task_status": "id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, operation STRING, trackable_id BIGINT, trackable_type STRING, parent STRING, message STRING, state STRING, error STRING, total INT, current INT",
        "pipelines": "id BIGINT, name STRING",
        "steps": "id BIGINT, name STRING, kind STRING",
        "pipeline_steps": "pipeline_id BIGINT, step_id BIGINT, join_type STRING",
        "step_dependencies": "step_id BIGINT, depends_on_id BIGINT",
        "http_cache": "key STRING, status_code INT, header BINARY, body BINARY",
    }.items()
}

KEYS: dict[str, tuple[str, ...]] = {
    "git_repos": ("id",), "git_commits": ("commit_sha",), "git_branches": ("repo_id", "name"), "git_tags": ("repo_id", "name"),
    "git_commit_files": ("commit_sha", "path"), "enrichments_v2": ("id",), "enrichment_associations": ("enrichment_id", "entity_type", "entity_id"),
    "source_locations": ("enrichment_id",), "keyword_index": ("snippet_id",), "vector_index": ("task", "snippet_id"), "tasks": ("dedup_key",), "task_status": ("id",), "http_cache": ("key",),
}


def validate_schema(df: DataFrame, table: str) -> list[str]:
    """``table.column`` of every column that is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{table}.{f.name}" for f in TABLES[table] if have.get(f.name) != f.dataType]


def check_dimension(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The rows whose vector has another length: what a change of dimension must index anew."""
    from pyspark.sql import functions as F

    return df.where(F.size(column) != dimension)
