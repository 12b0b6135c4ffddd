"""Directories and result files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_unless_binary, extension, glob_match, language_of, media_type
from ..operators.relational import directory_hash


def scan_directory(spark: SparkSession, root: str, pattern: str | None = None, with_content: bool = True) -> DataFrame:
    """Files below a folder: path (relative), size, modified, extension, language, mime_type and, with
    content, blob_sha, content and text.

    Without content only the listing is read. The .git folder is left out, and files that go away
    meanwhile are skipped.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(base)
    tail = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^.*?{_escaped(base)}/", "")
    columns = [tail.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_content:
        columns += [F.sha2("content", 256).alias("blob_sha"), "content", decode_unless_binary(F.col("content")).alias("text")]
    files = rows.select(*columns).where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    files = files.withColumns({"extension": extension(F.col("path")), "language": language_of(F.col("path")), "mime_type": media_type(extension(F.col("path")))})
    return files.where(glob_match(F.col("path"), pattern)) if pattern else files


def _escaped(base: str) -> str:
    import re

    return re.escape(base.split("://", 1)[-1].removeprefix("file:"))


def directory_branch(files: DataFrame) -> DataFrame:
    """A folder without history as one branch, headed by a hash of its files' paths and bytes."""
    head = directory_hash(files.select(F.lit(1).alias("one"), "path", "content"), ["one"], "path", "content")
    return head.select(F.lit("main").alias("name"), F.col("hash").alias("head_commit_sha"), F.lit(True).alias("is_default"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of instance_id, model_name_or_path and model_patch; blank lines do not count."""
    rows = spark.read.schema("instance_id STRING, model_name_or_path STRING, model_patch STRING, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("instance_id IS NOT NULL").drop("_corrupt")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("instance_id", "model_name_or_path", "model_patch").write.mode("append").json(path)


def predictions_from_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of predictions by id, as rows."""
    text = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", "map<string,struct<model_name_or_path:string,model_patch:string>>")
    return text.select(F.explode(entries).alias("instance_id", "p")).select("instance_id", "p.model_name_or_path", "p.model_patch")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of a benchmark run: counts, and the ids by outcome."""
    schema = "total_instances INT, submitted_instances INT, completed_instances INT, resolved_instances INT, unresolved_instances INT, empty_patch_instances INT, error_instances INT, resolved_ids ARRAY<STRING>, unresolved_ids ARRAY<STRING>, error_ids ARRAY<STRING>, schema_version INT"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def find_instance(dataset: DataFrame, number: str) -> DataFrame:
    found = dataset.where(F.col("instance_id") == number)
    if found.isEmpty():
        raise KeyError(number)
    return found


def search_results(responses: DataFrame, column: str = "body") -> DataFrame:
    """Rows of a search response: id, content, language and score."""
    shape = "struct<data:array<struct<id:string,attributes:struct<content:string,language:string,score:double>>>>"
    return responses.select(F.explode(F.from_json(column, shape)["data"]).alias("d")).select("d.id", "d.attributes.*")


def jsonapi_rows(rows: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """Each row as one JSON:API object."""
    others = [c for c in rows.columns if c != key]
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), F.struct(*others).alias("attributes"))).alias("value"))


def through_cache(requests: DataFrame, cache: DataFrame, fetch) -> tuple[DataFrame, DataFrame]:
    """Answers of requests (method, url, body), and the rows to add to the cache.

    ``fetch`` turns the missing requests into key, status_code, header and body; only answers of
    2xx are kept.
    """
    from ..functions.text import cache_key

    keyed = requests.withColumn("key", cache_key(F.col("method"), F.col("url"), F.col("body"))).drop("body")
    known = keyed.join(cache, "key")
    fresh = fetch(keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]))
    answered = known.select("key", "status_code", "header", "body").unionByName(fresh.select("key", "status_code", "header", "body"))
    return answered, fresh.where(F.col("status_code").between(200, 299)).select("key", "status_code", "header", "body")
