"""Catalogue entries of text, path, JSON and document functions, of ingestion steps and of file formats, with their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as X
from ..functions.chunker import ChunkConfig
from ..operators import options as O
from ..operators import relational as R
from ..schemas import check_dimension
from ..session import shared_folder, ship_package
from ..sources import files, git
from ..streaming import queue
from . import ingest, retrieval
from .catalogue import query


def _by_row(rows: DataFrame, fn: Callable, schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Rows that a Python function of a row's values yields, by Arrow batches."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in fn(*values)]
            yield pa.RecordBatch.from_pylist([dict(zip([n for n, _ in fields], r, strict=True)) for r in out], schema=pa.schema(fields))

    return rows.mapInArrow(run, schema)


# --- lines, tokens, paths


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, text AS joined FROM documents")
def lines_kept(documents):
    """Lines with their line feeds; joined they are the text."""
    kept = X.lines_kept(F.col("text"))
    return documents.select("doc_id", F.size(kept).cast("long").alias("lines"), F.array_join(kept, "").alias("joined"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^ \\t]*[ \\t]*'), lambda t: t <> '')) AS tokens, list_max(list_transform(regexp_extract_all(text, '[^ \\t]*[ \\t]*'), lambda t: length(t))) AS longest FROM documents")
def blank_tokens(documents):
    tokens = X.blank_tokens(F.col("text"))
    return documents.select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.array_max(F.transform(tokens, lambda t: F.length(t))).cast("long").alias("longest"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/' || page_id || '.py' WHEN 1 THEN 'src/' || page_id || '.go' ELSE 'a/' || page_id END AS shown,
page_id % 4 IN (0, 1) AS indexable, page_id % 3 = 0 AS test, CASE page_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE '' END AS ext, page_id % 4 <> 3 AS safe FROM pages""")
def path_functions(pages):
    """Clone paths made relative, which files count, and which paths stay inside their folder."""
    k, number = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/data/clones/h_r/x/repos/r1/src/"), number, F.lit(".py"))).when(k == 1, F.concat(F.lit("/data/repos/h_r/src/"), number, F.lit(".go"))).otherwise(F.concat(F.lit("/data/clones/h_r/a/"), number))
    relative = X.relative_path(path)
    probe = F.when(k == 3, F.concat(F.lit("a/../../"), number)).otherwise(F.concat(F.lit("a/./../b/"), number))
    named = F.concat(F.lit("src/"), F.when(F.col("page_id") % 3 == 0, "a_test").otherwise("plain"), F.lit(".py"))
    return pages.select("page_id", relative.alias("shown"), X.is_indexable(relative).alias("indexable"), X.is_test_file(named).alias("test"), X.extension(relative).alias("ext"), X.is_safe_path(probe).alias("safe"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '//[^@/]*@', '//'), '^[a-z+]+://', ''), '[^A-Za-z0-9._-]', '_', 'g') AS plain, url FROM pages)
SELECT page_id, CASE WHEN length(plain) <= 30 THEN plain ELSE substr(plain, 1, 21) || '_' || substr(sha256(url), 1, 8) END AS folder FROM p""")
def uri_folders(pages):
    return pages.select("page_id", X.uri_folder(F.col("url"), 30).alias("folder"))


@query("SELECT event_id, props::JSON ->> '$.k' AS k, event_type AS z, CASE WHEN event_id % 2 = 0 THEN 'right' ELSE event_type END AS winner FROM events")
def merge_payloads(events):
    """Top-level keys of two payloads, the right one's values first."""
    left = F.to_json(F.struct("event_type", F.col("event_type").alias("who"), F.get_json_object("props", "$.k").alias("k")))
    right = F.when(F.col("event_id") % 2 == 0, F.lit('{"who": "right", "extra": "1"}')).otherwise(F.lit('{"extra": "2"}'))
    merged = X.merge_json(left, right)
    return events.select("event_id", F.get_json_object(merged, "$.k").alias("k"), F.get_json_object(merged, "$.event_type").alias("z"), F.get_json_object(merged, "$.who").alias("winner"))


# --- what models and people write


@query("""SELECT conv_id, turn, '{"role": "' || role || '", "inner": {"n": ' || turn || ', "brace": "}{"}}' AS found FROM conversations""")
def json_in_answers(conversations):
    """The first balanced object of an answer, whatever its strings hold."""
    body = F.concat(F.lit('{"role": "'), "role", F.lit('", "inner": {"n": '), F.col("turn").cast("string"), F.lit(', "brace": "}{"}}'))
    told = conversations.select("conv_id", "turn", F.concat(F.lit("Well: "), F.translate("text", "{}", ""), F.lit("\n```json\n"), body, F.lit("\n``` {\"later\": 1}")).alias("told"))
    return _by_row(told, lambda c, t, text: [(c, t, D.first_json(text))], "conv_id long, turn long, found string", [("conv_id", pa.int64()), ("turn", pa.int64()), ("found", pa.string())])


@query("""SELECT r_name AS slug, r_name AS path, 'Region ' || r_regionkey AS title, 0 AS depth FROM region UNION ALL SELECT n_name, r_name || '/' || n_name, 'Nation ' || n_nationkey, 1 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def wiki_pages(region, nation):
    """A page tree of regions and nations, written as JSON and flattened again."""
    children = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("slug"), F.concat(F.lit("Nation "), "n_nationkey").alias("title"))).alias("children"))
    page = F.struct(F.col("r_name").alias("slug"), F.concat(F.lit("Region "), "r_regionkey").alias("title"), "children")
    tree = region.join(children, "r_regionkey", "left").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("tree"))

    def flat(text: str):
        pages = D.parse_wiki(text)
        return D.flatten(D.rebuild(D.flatten(D.parse_wiki(D.wiki_json(pages)))))

    return _by_row(tree, flat, "slug string, path string, title string, depth int", [("slug", pa.string()), ("path", pa.string()), ("title", pa.string()), ("depth", pa.int32())])


@query("""SELECT n_nationkey, 'see [home](/w/' || r_name || '/' || n_name || '), [up](/w/' || r_name || '), [web](https://x/' || n_name || '), [abs](/a), [none](NOWHERE)' AS text FROM nation JOIN region ON r_regionkey = n_regionkey""")
def wiki_links(region, nation):
    """Links to known pages lead to their paths; web, absolute and unknown ones stay."""
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    known = rows.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct(F.col("n_name").alias("k"), F.concat("r_name", F.lit("/"), "n_name").alias("v"))))).alias("paths"))
    text = F.concat(F.lit("see [home]("), "n_name", F.lit("), [up](./"), "r_name", F.lit(".md), [web](https://x/"), "n_name", F.lit("), [abs](/a), [none](NOWHERE)"))
    asked = rows.join(known, "n_regionkey").select("n_nationkey", "r_name", text.alias("text"), "paths")
    return _by_row(asked, lambda k, r, t, p: [(k, D.rewrite_links(t, json.loads(p) | {r: r}, "/w/"))], "n_nationkey int, text string", [("n_nationkey", pa.int32()), ("text", pa.string())])


@query("""SELECT conv_id, turn, 'md' AS kind, 'py' AS language, 'x = ' || turn || chr(10) || 'y' AS code, 5::INT AS line_start, 6::INT AS line_end, 'Title Some prose.' AS context FROM conversations
UNION ALL SELECT conv_id, turn, 'rst', 'sh', 'run ' || turn || chr(10) || '  more', 4::INT, 5::INT, 'Prose.' FROM conversations""")
def code_blocks(conversations):
    """Code in Markdown fences and in indented directives, with what stands before it."""
    n = F.col("turn").cast("string")
    md = F.concat(F.lit("# Title\n\nSome prose.\n```py\nx = "), n, F.lit("\ny\n```\ntail"))
    rst = F.concat(F.lit("Prose.\n.. code-block:: sh\n\n    run "), n, F.lit("\n      more\n\nEnd."))
    texts = conversations.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("md").alias("kind"), md.alias("text")), F.struct(F.lit("rst").alias("kind"), rst.alias("text")))).alias("d")).select("conv_id", "turn", "d.kind", "d.text")

    def blocks(conv: int, turn: int, kind: str, text: str):
        for b in D.markdown_blocks(text) if kind == "md" else D.rst_blocks(text):
            yield conv, turn, kind, b.language, b.code, b.line_start, b.line_end, b.context

    names = [("conv_id", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("language", pa.string()), ("code", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("context", pa.string())]
    return _by_row(texts, blocks, "conv_id long, turn long, kind string, language string, code string, line_start int, line_end int, context string", names)


@query("""SELECT doc_id, 'src/' || source || '.py,lib/' || lang || '.py' AS files, true AS valid, source IN ('src1', 'src2') OR lang = 'en' AS overlaps FROM documents""")
def patches(documents):
    """Paths that a diff names, and whether any is among the right ones."""
    patch = F.concat(F.lit("diff --git a/src/"), "source", F.lit(".py b/src/"), "source", F.lit(".py\n--- a/src/"), "source", F.lit(".py\n+++ b/src/x\n--- a/lib/"), "lang", F.lit(".py\n"))
    gold = F.array(*[F.lit(p) for p in ("src/src1.py", "src/src2.py", "lib/en.py")])
    return documents.select("doc_id", F.array_join(X.patch_files(patch), ",").alias("files"), X.is_patch(patch).alias("valid"), F.arrays_overlap(X.patch_files(patch), gold).alias("overlaps"))


# --- options


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity * l_discount DESC, l_orderkey, l_linenumber, l_quantity LIMIT 40 OFFSET 40")
def raw_order_page(lineitem):
    """An order by an expression, and the second page of 40."""
    q = O.build(O.with_raw_order("-(l_quantity * l_discount)"), O.with_order_asc("l_orderkey"), O.with_order_asc("l_linenumber"), O.with_order_asc("l_quantity"), O.with_select("l_orderkey", "l_linenumber", "l_quantity"))
    return q.paginate(2, 40).apply(lineitem)


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value >= 10 AND value < 20 AND event_id NOT IN (1, 2, 3) AND event_type LIKE 'c%' ORDER BY value DESC, event_id LIMIT 10")
def fluent_query(events):
    """The fluent builder; a page and a size below 1 are the first page of 10."""
    q = O.Query().where("event_type", "IN", ["click", "view"]).where("value", ">=", 10).where("value", "<", 20).where("event_id", "NOT IN", [1, 2, 3]).where("event_type", "LIKE", "c%")
    return q.order_by("value", descending=True).order_by("event_id").paginate(0, 0).apply(events).select("event_id")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 5) AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey < 4000)")
def long_in_list(customer):
    """A list of some thousand values is joined, a short one is a predicate."""
    return O.build(O.with_condition_in("c_nationkey", [3, 5]), O.with_condition_in("c_custkey", range(0, 4000, 2))).apply(customer).select("c_custkey", "c_nationkey")


@query("SELECT count(*) AS n, 0 AS empty FROM events WHERE event_type = 'view' AND user_id IN (1, 2, 3)")
def filters_fail_closed(events):
    """An empty list matches nothing, no list restricts nothing."""
    names = {"types": "event_type", "source_repos": "user_id"}
    some, none = O.Filters(types=("view",), source_repos=(1, 2, 3)), O.Filters(types=("view",), source_repos=()).scoped([1, 2])
    return events.agg(F.count_if(some.predicate(names)).alias("n"), F.count_if(none.predicate(names)).cast("int").alias("empty"))


# --- ingestion


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT user_id, n, unnest(generate_series(0, greatest((n - 3) // 8, 0))) AS k FROM u),
l AS (SELECT user_id, lpad(event_id::VARCHAR, 9, '0') || chr(10) AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT k.user_id, k.k::INT AS chunk_no, string_agg(line, '' ORDER BY i) AS content, (k.k * 80)::BIGINT AS "offset", (k.k * 8 + 1)::INT AS start_line, (k.k * 8 + count(*))::INT AS end_line FROM k JOIN l ON l.user_id = k.user_id AND l.i >= k.k * 8 AND l.i < k.k * 8 + 10 GROUP BY k.user_id, k.k""")
def line_chunks(events):
    """Chunks of whole lines, 100 characters that share the lines of the last 25: with lines of ten they are ten lines, eight on."""
    lines = F.array_sort(F.collect_list(F.lpad(F.col("event_id").cast("string"), 9, "0")))
    rows = events.groupBy("user_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return ingest.chunk_files(rows, ChunkConfig(100, 25, 1), "user_id", "content").select("user_id", "chunk_no", "content", "offset", "start_line", "end_line")


@query("""WITH n AS (SELECT count(*) AS n FROM (SELECT doc_id, unnest(generate_series(0, greatest((length(text) - 50 - 1), 0) // 250)) AS k FROM documents WHERE length(text) > 0))
SELECT t.t AS entity_type, (SELECT n FROM n) - CASE WHEN t.t = 'git_commit_files' THEN (SELECT count(*) FROM (SELECT unnest(generate_series(0, greatest((length(text) - 50 - 1), 0) // 250)) FROM documents WHERE doc_id = 0)) ELSE 0 END AS n FROM (VALUES ('git_commits'), ('git_commit_files'), ('git_repos')) t(t)""")
def chunk_tables(documents):
    """Associations of window chunks by kind: three a chunk, but none to a file without a number."""
    found = ingest.window_chunks(documents, 300, 50, "doc_id", "text").withColumnRenamed("chunk", "content").withColumns({"chunk_no": (F.col("start") / 250).cast("int"), "start_line": F.lit(1), "end_line": F.lit(1)})
    where = documents.select("doc_id", F.lit(1).alias("repo_id"), F.lit("c").alias("commit_sha"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return ingest.chunk_tables(found, where, "doc_id")["enrichment_associations"].groupBy("entity_type").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT conv_id, turn, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM conversations)
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content, string_agg(turn || ':' || pos, ',' ORDER BY turn) AS boundaries FROM o GROUP BY conv_id""")
def joined_pages(conversations):
    """Turns as pages of one text, with the byte at which each begins."""
    rows = ingest.pages_text(conversations.select("conv_id", F.col("turn").alias("page"), "text"), "conv_id")
    return rows.select("conv_id", "content", F.array_join(F.transform("boundaries", lambda b: F.concat_ws(":", b["page"].cast("string"), b["byte_offset"].cast("string"))), ",").alias("boundaries"))


@query("SELECT p_partkey, unnest(generate_series(1, p_size)) AS page, '' AS content FROM part WHERE p_size > 0 AND p_partkey % 7 = 0 UNION ALL SELECT p_partkey, unnest(generate_series(1, p_size)), '' FROM part WHERE p_size > 0 AND p_partkey % 7 > 0")
def page_rows(part):
    """An empty row for each page of each file."""
    return ingest.page_rows(part.select("p_partkey", F.col("p_size").cast("long").alias("p_size")), "p_size").select("p_partkey", "page", "content")


@query("SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings) WHERE len(e) <> 64")
def vectors_of_other_length(embeddings):
    """What a change of the model's dimension must embed anew."""
    rows = embeddings.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return check_dimension(rows, 64).select("vec_id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 1 AND (SELECT count(*) FROM events WHERE event_type = 'none') = 0")
def periodic_sync(customer, events):
    """Repositories never scanned or not for long, as long as nothing is queued."""
    moment = F.when(F.col("c_custkey") % 3 == 1, F.to_timestamp(F.lit("2024-01-09"))).when(F.col("c_custkey") % 3 == 2, F.to_timestamp(F.lit("2024-01-01")))
    from datetime import datetime, timedelta

    repos = customer.select(F.col("c_custkey").alias("id"), moment.alias("last_scanned_at"))
    return queue.periodic(events.where("event_type = 'none'"), repos, datetime(2024, 1, 10), timedelta(days=5)).unionByName(queue.periodic(events, repos, datetime(2024, 1, 10))).select("id")


# --- formats


@query("""SELECT o_custkey, o_orderkey::VARCHAR AS commit_sha, CASE WHEN o_orderkey % 3 > 0 THEN 'p' || o_orderkey END AS parent_commit_sha, o_orderpriority || ' <' || o_orderkey || '@x>' AS author, strftime(o_orderdate, '%Y-%m-%d %H') AS day, 'status ' || o_orderstatus || chr(10) || 'more' AS message FROM orders WHERE o_orderkey % 11 > 0""")
def commit_logs(orders):
    """Log texts, one a customer, parsed into commits; records with too few fields go, and of parents only the first counts."""
    sha = F.col("o_orderkey").cast("string")
    parents = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("p"), sha)).otherwise(F.concat(F.lit("p"), sha, F.lit(" q")))
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    fields = [sha, parents, F.col("o_orderpriority"), F.concat(sha, F.lit("@x")), at, F.lit("c"), F.lit("c@x"), at, F.concat(F.lit("status "), "o_orderstatus", F.lit("\nmore\n"))]
    record = F.when(F.col("o_orderkey") % 11 > 0, F.concat_ws("\0", *fields)).otherwise(F.concat_ws("\0", sha, F.lit("broken")))
    logs = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("\1"), record)), "").alias("log"))
    rows = git.parse_log(logs)
    return rows.select("o_custkey", "commit_sha", "parent_commit_sha", "author", F.date_format("date", "yyyy-MM-dd HH").alias("day"), "message")


@query("SELECT doc_id::VARCHAR AS instance_id, 'm' || doc_id % 3 AS model_name_or_path, text AS model_patch FROM documents")
def predictions_round_trip(documents):
    """Predictions written as JSON lines and read back; blank lines do not count."""
    path = f"{shared_folder(documents.sparkSession)}/lodestone-predictions-{uuid.uuid4().hex}"
    rows = documents.select(F.col("doc_id").cast("string").alias("instance_id"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model_name_or_path"), F.col("text").alias("model_patch"))
    files.write_predictions(rows, path)
    documents.sparkSession.range(1).select(F.lit("").alias("value")).write.mode("append").text(path)
    return files.read_predictions(documents.sparkSession, path)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cached' ELSE 'fetched' END AS source, page_id % 3 > 0 AND page_id % 5 > 0 AS kept FROM pages")
def response_cache(pages):
    """Requests through the cache: what it knows is not asked again, and only good answers are kept."""
    requests = pages.select("page_id", F.lit("GET").alias("method"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.lit("").alias("body"))
    keyed = requests.withColumn("key", X.cache_key(F.col("method"), F.col("url"), F.col("body")))
    answer = lambda rows, body: rows.select("key", body.alias("body"), F.lit(None).cast("binary").alias("header"))
    cache = answer(keyed.where("page_id % 3 = 0"), F.encode(F.lit("cached"), "UTF-8")).withColumn("status_code", F.lit(200))
    status = keyed.select("key", F.when(F.col("page_id") % 5 == 0, 500).otherwise(200).alias("status_code"))
    answered, fresh = files.through_cache(requests.drop("page_id"), cache, lambda missing: answer(missing, F.encode(F.lit("fetched"), "UTF-8")).join(status, "key"))
    return keyed.join(answered.select("key", F.decode("body", "UTF-8").alias("source")), "key").join(fresh.select("key", F.lit(True).alias("_kept")), "key", "left").select("page_id", "source", F.coalesce("_kept", F.lit(False)).alias("kept"))


@query("""SELECT doc_id::VARCHAR AS id, text AS content, lang AS language, n_chars / 2.0 AS score FROM documents""")
def search_responses(documents):
    """Responses of a search as JSON, and their rows again."""
    row = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.col("text").alias("content"), F.col("lang").alias("language"), (F.col("n_chars") / 2).alias("score")).alias("attributes"))
    bodies = documents.groupBy((F.col("doc_id") % 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("body"))
    return files.search_results(bodies)


@query("""SELECT doc_id, 'Files: ' || 'src/' || source || '.py' || chr(10) || chr(10) || '### ' || lang || chr(10) || text AS prompt FROM documents""")
def prompts(documents):
    """What a solver is told: the files that the right patch touches, and the snippets that were found."""
    patch = F.concat(F.lit("diff --git a/src/"), "source", F.lit(".py b/src/"), "source", F.lit(".py\n"))
    snippets = F.array(F.struct(F.col("lang").alias("language"), F.col("text").alias("content")))
    return documents.select("doc_id", prompt(X.patch_files(patch), snippets).alias("prompt"))


def prompt(paths: Column, snippets: Column) -> Column:
    """File paths once each and snippets (language, content) as one text."""
    shown = F.transform(snippets, lambda s: F.concat(F.lit("### "), s["language"], F.lit("\n"), s["content"]))
    return F.concat(F.lit("Files: "), F.array_join(F.array_distinct(paths), ", "), F.lit("\n\n"), F.array_join(shown, "\n\n"))


@query("""SELECT l_orderkey, 'service' || l_orderkey AS name, string_agg(DISTINCT 'service' || l_suppkey, ',' ORDER BY 'service' || l_suppkey) AS needs FROM lineitem WHERE l_suppkey <> l_orderkey GROUP BY l_orderkey""")
def service_edges(lineitem):
    """Compose files of services that depend on each other, as edges."""
    rows = lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("needs"))

    def edges(order: int, needs: list[int]):
        names = [f"service{n}" for n in needs if n != order]
        services = {f"service{order}": {"depends_on": names[::2], "environment": {f"U{k}": f"http://u:p@{n}:80/x" for k, n in enumerate(names[1::2])}}, **{n: {} for n in names}}
        found = sorted({other for service, other, _ in D.compose_edges(services) if service == f"service{order}"})
        if found:
            yield order, f"service{order}", ",".join(found)

    return _by_row(rows, edges, "l_orderkey long, name string, needs string", [("l_orderkey", pa.int64()), ("name", pa.string()), ("needs", pa.string())])


@query("""WITH v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS s FROM embeddings)
SELECT vec_id, round(-s, 6) AS stored, round(1 - (1 - s) / 2, 6) AS scaled FROM v ORDER BY s DESC, vec_id LIMIT 10""")
def score_scales(embeddings):
    """Scores as one backend stores them, negated, and as the other one scales them; no limit means ten."""
    target = embeddings.where("vec_id = 3").first()["embedding"]
    found = retrieval.exact_topk(embeddings, target, retrieval._top(0), "vec_id")
    return found.select("vec_id", F.round(-F.col("score"), 6).alias("stored"), F.round(X.distance_similarity(1 - F.col("score")), 6).alias("scaled"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def new_of_two_indexes(documents, labels, embeddings):
    """Documents that neither of two indexes knows."""
    known = labels.select("doc_id").union(embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id")))
    return R.new_only(documents, known, "doc_id").select("doc_id")


@query("""WITH v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s FROM embeddings), a AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS r FROM v QUALIFY r < 15),
b AS (SELECT vec_id, embedding[1]::DOUBLE AS s, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 15)
SELECT coalesce(a.vec_id, b.vec_id)::VARCHAR AS id, round(coalesce(1 / (60.0 + a.r), 0) + coalesce(1 / (60.0 + b.r), 0), 9) AS score, round(coalesce(a.s, 0), 6) AS first, round(coalesce(b.s, 0), 6) AS second FROM a FULL JOIN b ON a.vec_id = b.vec_id""")
def fused_score_vectors(embeddings):
    """Fused lists whole, each id with its score in every list, 0 where it is missing."""
    target = embeddings.where("vec_id = 7").first()["embedding"]
    near = retrieval.exact_topk(embeddings, target, 15, "vec_id")
    first = embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(15)
    rows = retrieval.fuse(retrieval.with_rank(near, 0, "vec_id").unionByName(retrieval.with_rank(first, 1, "vec_id")), "vec_id", slots=2)
    return rows.select("id", F.round("score", 9).alias("score"), F.round(F.get("original_scores", 0), 6).alias("first"), F.round(F.get("original_scores", 1), 6).alias("second"))


@query("""WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT vec_id FROM embeddings WHERE label = 1)
SELECT 'union' AS name, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def solved_sets(labels, embeddings):
    """What two runs solved: together, both, and only the first."""
    a = labels.where("quality = 1").select("doc_id")
    b = labels.where("toxic = 1").select("doc_id").union(embeddings.where("label = 1").select("vec_id"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only first": a.subtract(b)}
    return R.reduce_union([d.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, d in parts.items()])


@query("SELECT conv_id, turn, role = 'user' AS from_user, role IN ('assistant') AS answer, strftime(TIMESTAMP '2024-01-01' + INTERVAL (turn) HOUR, '%Y-%m-%d %H') AS day FROM conversations")
def kinds_and_dates(conversations):
    """Type predicates as columns, and dates read, moved and written."""
    at = F.to_timestamp(F.lit("2024-01-01T00:00:00Z")) + F.make_dt_interval(hours=F.col("turn").cast("int"))
    return conversations.select("conv_id", "turn", (F.col("role") == "user").alias("from_user"), F.col("role").isin("assistant").alias("answer"), F.date_format(at, "yyyy-MM-dd HH").alias("day"))
