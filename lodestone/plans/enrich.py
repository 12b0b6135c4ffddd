"""Generated documents: interface overviews, commit descriptions, and texts by a model.

What is deterministic is planned in Spark; the model is a callable of the caller's (see
``ingest.generate``). A document that exists is not made again, and an attempt without a result leaves
an empty entry, which readers skip.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents
from ..functions import text as X
from ..operators.relational import new_only, ranked
from ..session import ship_package, written
from .endpoints import Catalog
from .ingest import generate

#: Fixed value: bytes of a diff that a model gets to see.
MOST_DIFF = 100_000


def api_docs(files: DataFrame, keys: tuple[str, ...] = ("commit_sha",)) -> DataFrame:
    """(keys, language, content): the interface blocks of a commit's files by language, in path order.

    ``files`` holds the keys, path, language and content. Test files are left out; a commit without
    any block keeps one empty entry, so it is not tried again.
    """
    rows = files.where((F.coalesce("language", F.lit("")) != "") & ~X.is_test_file(F.col("path")))
    block = F.lit("")
    for language in X.API_INDICATORS:
        block = F.when(F.col("language") == language, X.api_block(F.col("content"), F.col("path"), language)).otherwise(block)
    blocks = rows.select(*keys, "language", "path", block.alias("block")).where("block <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("path", "block")))
    found = blocks.groupBy(*keys, "language").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("content"))
    tried = files.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")
    return found.unionByName(tried.select(*keys, F.lit("").alias("language"), F.lit("").alias("content")))


def commit_descriptions(diffs: DataFrame, done: DataFrame, model: Callable[[str, str], str], system: str = "Describe this change.") -> DataFrame:
    """(commit_sha, answer, error) for commits with a diff and no description yet."""
    missing = diffs.join(done.select("commit_sha"), "commit_sha", "left_anti").where("diff <> ''")
    cut = X.truncate_bytes(F.col("diff"), MOST_DIFF, "\n[diff truncated]")
    answers = generate(missing.select("commit_sha", F.lit(system).alias("system"), cut.alias("text")), model, "commit_sha")
    return answers.withColumn("answer", X.drop_thinking(F.col("answer")))


def summaries(chunks: DataFrame, done: DataFrame, model: Callable[[str, str], str], system: str = "Summarise this code.") -> DataFrame:
    """(parent_id, answer, error) of chunks that no summary belongs to yet."""
    missing = chunks.join(done.select(F.col("parent_id").alias("id")), "id", "left_anti")
    return generate(missing.select(F.col("id").alias("parent_id"), F.lit(system).alias("system"), F.col("content").alias("text")), model, "parent_id")


def repository_context(files: DataFrame, keys: tuple[str, ...] = ("repo_id",), readme: int = 3000, manifest: int = 500, paths: int = 200) -> DataFrame:
    """(keys, context): readme, manifests and file tree of each repository, cut as a prompt needs."""
    base = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    manifests = ("package.json", "pyproject.toml", "go.mod", "cargo.toml", "pom.xml", "requirements.txt", "gemfile", "composer.json")
    parts = files.groupBy(*keys).agg(
        F.min(F.when(base.startswith("readme"), F.struct("path", F.substring("content", 1, readme).alias("t"))))["t"].alias("readme"),
        F.array_sort(F.collect_list(F.when(base.isin(*manifests), F.struct("path", F.substring("content", 1, manifest).alias("t"))))).alias("manifests"),
    )
    # only the first paths of a repository are gathered, however many it has
    first = ranked(files.select(*keys, "path"), keys, F.col("path")).where(F.col("rank") < paths)
    parts = parts.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("tree")), list(keys))
    shown = F.transform("manifests", lambda m: F.concat(m["path"], F.lit("\n"), m["t"]))
    return parts.select(*keys, F.concat_ws("\n\n", F.concat(F.lit("README\n"), "readme"), F.nullif(F.array_join(shown, "\n\n"), F.lit("")), F.concat(F.lit("Files\n"), F.array_join("tree", "\n"))).alias("context"))


# --- documents by a model


#: The kinds of documents a model writes about a commit, as (type, subtype).
DOCUMENTS = {"architecture": ("architecture", "physical"), "schema": ("architecture", "database_schema"), "cookbook": ("usage", "cookbook"), "wiki": ("usage", "wiki")}


def missing_documents(c: Catalog, targets: DataFrame, document: str) -> DataFrame:
    """The targets (commit_sha, …) that have no document of this kind yet."""
    kind, subtype = DOCUMENTS[document]
    rows = c["enrichments_v2"].where((F.col("type") == kind) & (F.col("subtype") == subtype)).select(F.col("id").alias("enrichment_id"))
    edges = c["enrichment_associations"].where("entity_type = 'git_commits'").join(rows, "enrichment_id", "left_semi")
    return new_only(targets, edges.select(F.col("entity_id").alias("commit_sha")), "commit_sha")


def document_rows(answers: DataFrame, document: str) -> dict[str, DataFrame]:
    """Enrichments and associations of (commit_sha, content); ids are hashes, so a rerun makes the same rows."""
    kind, subtype = DOCUMENTS[document]
    rows = answers.withColumn("id", F.abs(F.xxhash64("commit_sha", F.lit(kind), F.lit(subtype))))
    edge = F.abs(F.xxhash64("id", "commit_sha"))
    return {
        "enrichments_v2": rows.select("id", F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"), "content"),
        "enrichment_associations": rows.select(edge.alias("id"), F.col("id").alias("enrichment_id"), F.lit("git_commits").alias("entity_type"), F.col("commit_sha").alias("entity_id")),
    }


def write_documents(c: Catalog, contexts: DataFrame, document: str, model: Callable[[str, str], str], system: str, **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """One document for each commit of ``contexts`` (commit_sha, context) that lacks it, and the requests that failed.

    Commits whose context is empty have nothing to tell and are left out.
    """
    wanted = missing_documents(c, contexts, document).where(F.coalesce("context", F.lit("")) != "")
    told = generate(wanted.select("commit_sha", F.lit(system).alias("system"), F.col("context").alias("text")), model, "commit_sha", **options)
    told = written(told.select("commit_sha", X.drop_thinking(F.col("answer")).alias("content"), "error"), f"{document}-answers")
    return document_rows(told.where("error IS NULL"), document), told.where("error IS NOT NULL").select("commit_sha", "error")


def architecture_contexts(files: DataFrame, keys: tuple[str, ...] = ("commit_sha",)) -> DataFrame:
    """(keys, context): what the compose files of each commit tell about its services, by path."""
    ship_package(files.sparkSession)
    rows = files.where(F.regexp_extract(F.lower("path"), "[^/]*$", 0).rlike(r"^(docker-)?compose.*\.ya?ml$")).select(*keys, "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [documents.architecture_text(t or "") for t in batch.column(len(keys) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told, pa.string())], names=[*keys, "path", "told"])

    kinds = dict(files.dtypes)
    told = rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "path string, told string"])).where("told <> ''")
    return told.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "told"))), lambda r: F.concat(r["path"], F.lit("\n"), r["told"])), "\n\n").alias("context"))


def with_digests(contexts: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("repo_id",), most: int = 2000) -> DataFrame:
    """Contexts followed by earlier documents (keys, name, content), each cut to ``most`` bytes."""
    part = F.concat(F.col("name"), F.lit("\n"), X.truncate_bytes(F.col("content"), most, ""))
    digests = texts.where("content <> ''").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("part")))), lambda r: r["part"]), "\n\n").alias("_digests"))
    return contexts.join(digests, list(keys), "left").withColumn("context", F.concat_ws("\n\n", "context", "_digests")).drop("_digests")


def schema_contexts(files: DataFrame, keys: tuple[str, ...] = ("commit_sha",), per_file: int = 2000, most: int = 10_000) -> DataFrame:
    """(keys, context): what looks like a schema in each commit's files, each file and all of them cut by bytes."""
    path = F.lower("path")
    hit = path.rlike(r"(^|/)(migrations?|schemas?|models?|db)/") | path.rlike(r"\.(sql|prisma|graphql|proto)$") | path.contains("schema")
    part = F.concat(F.lit("--- "), "path", F.lit("\n"), X.truncate_bytes(F.col("content"), per_file, ""))
    rows = files.where(hit & F.col("content").isNotNull()).select(*keys, "path", part.alias("part"))
    # a file counts as long as those before it, by path, leave room
    before = F.coalesce(F.sum(F.octet_length("part")).over(Window.partitionBy(*keys).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_before", before).where(F.col("_before") < most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "part"))), lambda r: r["part"]), "\n").alias("context"))


# --- wikis


PLAN, PAGE, INDEX = "Plan a wiki as JSON pages of slug, title, sources and children.", "Write this page of the wiki in Markdown.", "Write the first page of the wiki in Markdown."


def outline_pages(plans: DataFrame) -> DataFrame:
    """(commit_sha, position, depth, slug, title, sources, error): the pages of planned outlines in pre-order.

    The first JSON object of an answer is the outline; an answer without one keeps a row with the error.
    """
    ship_package(plans.sparkSession)
    fields = [("commit_sha", pa.string()), ("position", pa.int32()), ("depth", pa.int32()), ("slug", pa.string()), ("title", pa.string()), ("sources", pa.list_(pa.string())), ("error", pa.string())]

    def walk(pages: list, depth: int) -> Iterator[tuple]:
        for p in pages or []:
            yield depth, p["slug"], p.get("title") or "", p.get("sources") or []
            yield from walk(p.get("children"), depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, answer in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                try:
                    found = list(walk(json.loads(documents.first_json(answer or "") or "").get("pages"), 0))
                    rows += [dict(zip([n for n, _ in fields], (sha, k, *page, None), strict=True)) for k, page in enumerate(found)]
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append({"commit_sha": sha, "error": f"no outline: {type(e).__name__}"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return plans.select("commit_sha", "answer").mapInArrow(run, "commit_sha string, position int, depth int, slug string, title string, sources array<string>, error string")


def page_sources(pages: DataFrame, files: DataFrame, contexts: DataFrame, digests: DataFrame, most: int = 3000) -> DataFrame:
    """(commit_sha, position, text): what the writer of each page is shown.

    Sources are files (commit_sha, path, content), each cut, or earlier documents (commit_sha, digest),
    once a page; a page without any that is there gets the commit's whole context.
    """
    asked = pages.select("commit_sha", "position", F.posexplode("sources").alias("order", "source"))
    text = F.concat(F.lit("### "), "source", F.lit("\n```\n"), X.truncate_bytes(F.col("content"), most, ""), F.lit("\n```"))
    shown = asked.join(files.select("commit_sha", F.col("path").alias("source"), "content"), ["commit_sha", "source"]).where("content <> ''").select("commit_sha", "position", "order", text.alias("part"))
    earlier = asked.where(F.col("source").endswith("_enrichment")).groupBy("commit_sha", "position").agg(F.min("order").alias("order")).join(digests.select("commit_sha", F.col("digest").alias("part")), "commit_sha")
    parts = shown.unionByName(earlier.select("commit_sha", "position", "order", "part")).groupBy("commit_sha", "position").agg(F.array_sort(F.collect_list(F.struct("order", "part"))).alias("parts"))
    rows = pages.select("commit_sha", "position").join(parts, ["commit_sha", "position"], "left").join(contexts.select("commit_sha", "context"), "commit_sha", "left")
    return rows.select("commit_sha", "position", F.coalesce(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), "context", F.lit("")).alias("text"))


def wikis(c: Catalog, contexts: DataFrame, files: DataFrame, digests: DataFrame, model: Callable[[str, str], str], **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """A wiki for each commit of ``contexts`` (commit_sha, context) that lacks one, and the commits whose plan failed.

    Three rounds of requests over all commits at once: outlines, then all pages, then the first pages.
    A page without an answer is left out with what is below it.
    """
    wanted = written(missing_documents(c, contexts, "wiki").where(F.coalesce("context", F.lit("")) != ""), "wiki-contexts")
    ask = lambda rows, key, system: written(generate(rows.withColumn("system", F.lit(system)), model, key, **options), "wiki-answers")
    plans = ask(wanted.select("commit_sha", F.col("context").alias("text")), "commit_sha", PLAN)
    outline = written(outline_pages(plans.where("error IS NULL")), "wiki-outlines")
    pages = outline.where("error IS NULL")
    listing = pages.groupBy("commit_sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "depth", "slug", "title"))), lambda p: F.concat(F.repeat(F.lit("  "), p["depth"]), F.lit("- "), p["title"], F.lit(" ("), p["slug"], F.lit(")"))), "\n").alias("listing"))
    sources = page_sources(pages, files, contexts, digests)
    prompts = pages.join(sources, ["commit_sha", "position"]).join(listing, "commit_sha").select(F.concat_ws("/", "commit_sha", F.col("position").cast("string")).alias("key"), F.concat_ws("\n\n", "title", "slug", "listing", "text").alias("text"))
    told = ask(prompts, "key", PAGE).where("error IS NULL").select("key", X.strip_fence(F.col("answer")).alias("content"))
    first = ask(wanted.join(listing, "commit_sha").select("commit_sha", F.concat_ws("\n\n", "listing", "context").alias("text")), "commit_sha", INDEX).where("error IS NULL").select("commit_sha", X.strip_fence(F.col("answer")).alias("content"))
    flat = pages.withColumn("key", F.concat_ws("/", "commit_sha", F.col("position").cast("string"))).join(told, "key", "left").select("commit_sha", "position", "depth", "slug", "title", "content")
    flat = flat.unionByName(first.select("commit_sha", F.lit(-1).alias("position"), F.lit(0).alias("depth"), F.lit("index").alias("slug"), F.lit("Home").alias("title"), "content"))
    grouped = flat.groupBy("commit_sha").agg(F.array_sort(F.collect_list(F.struct("position", "depth", "slug", "title", "content"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for rows in batch.column(1).to_pylist():
                roots, stack, cut = [], [], None
                for r in rows:
                    if cut is not None and r["depth"] > cut:
                        continue
                    cut = None
                    if r["content"] is None:
                        cut = r["depth"]
                        continue
                    page = documents.WikiPage(r["slug"], r["title"], r["content"])
                    del stack[r["depth"] :]
                    (stack[-1].children if stack else roots).append(page)
                    stack.append(page)
                texts.append(documents.wiki_json(roots))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["commit_sha", "content"])

    done = grouped.mapInArrow(run, "commit_sha string, content string")
    failed = plans.where("error IS NOT NULL").select("commit_sha", "error").unionByName(outline.where("error IS NOT NULL").select("commit_sha", "error"))
    return document_rows(done, "wiki"), failed
