"""The query catalogue: every operator on the driver's tables, with the SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.porter2 import ENDINGS, STOP_WORDS, stem
from ..functions.registry import document_pages
from ..operators import mutations as M
from ..operators import options as O
from ..operators import relational as R
from ..operators.sketches import SketchTable
from ..session import shared_folder, ship_package
from . import ingest, retrieval
from .dag import depths
from .grep_index import shared_grep
from .keyword import shared_index
from .vector_index import shared_vectors

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of tables under its name; its parameters name the tables it reads."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- scans, filters, projections


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def scan_ordered_page(documents):
    q = O.build(O.with_select("doc_id", "lang", "n_chars"), O.with_pagination(25, 50))
    return q.apply(documents, key="doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars > 100")
def filter_eq_in_options(documents):
    return O.build(O.with_condition("lang", "en"), O.with_condition_in("source", ["src1", "src2", "src3"]), O.with_where("n_chars > 100"), O.with_select("doc_id", "lang", "source")).apply(documents)


_OPS = (
    ("eq", "l_returnflag", "=", "R", "l_returnflag = 'R'"),
    ("ne", "l_returnflag", "!=", "R", "l_returnflag <> 'R'"),
    ("gt", "l_quantity", ">", 40.0, "l_quantity > 40"),
    ("ge", "l_quantity", ">=", 40.0, "l_quantity >= 40"),
    ("lt", "l_quantity", "<", 5.0, "l_quantity < 5"),
    ("le", "l_quantity", "<=", 5.0, "l_quantity <= 5"),
    ("like", "l_linestatus", "LIKE", "O%", "l_linestatus LIKE 'O%'"),
    ("ilike", "l_linestatus", "ILIKE", "o%", "l_linestatus ILIKE 'o%'"),
    ("in", "l_linenumber", "IN", [1, 3], "l_linenumber IN (1, 3)"),
    ("not_in", "l_linenumber", "NOT IN", [1, 3], "l_linenumber NOT IN (1, 3)"),
    ("is_null", "l_shipdate", "IS NULL", None, "l_shipdate IS NULL"),
    ("is_not_null", "l_shipdate", "IS NOT NULL", None, "l_shipdate IS NOT NULL"),
    ("between", "l_discount", "BETWEEN", (0.02, 0.05), "l_discount BETWEEN 0.02 AND 0.05"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS op, count(*) AS n FROM lineitem WHERE {sql}" for n, _, _, _, sql in _OPS))
def filter_all_13_ops(lineitem):
    # one pass: each comparison is a conditional count
    counts = lineitem.agg(*[F.count_if(O.compare(c, op, v)).alias(n) for n, c, op, v, _ in _OPS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("op"), F.col(n).alias("n")) for n, *_ in _OPS])).alias("r")).select("r.op", "r.n")


@query("SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '1998-01-01'")
def filter_scan_due(customer, orders):
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = customer.select("c_custkey").join(last, "c_custkey", "left")
    return O.build(lambda q: O.with_where("last IS NULL OR last < TIMESTAMP_NTZ '1998-01-01'")(q)).apply(rows)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def filter_created_range(events):
    f = O.Filters(types=("click", "view"), created_after=__import__("datetime").datetime(2024, 1, 10), created_before=__import__("datetime").datetime(2024, 1, 12))
    return events.where(f.predicate({"types": "event_type", "created": "ts"})).select("event_id", "event_type")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*/en/[^/]*\\.html$')")
def filter_file_paths(pages):
    return pages.where(O.Filters(file_paths=("https://*/en/*.html",)).predicate({"file_paths": "url"})).select("page_id", "url")


@query("SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '/([^/?#]*)[^/]*$', 1), '^(v[0-9]|[0-9])')")
def filter_version_tag(pages):
    return pages.where(X.is_version_tag(F.regexp_extract("url", "/([^/?#]*)[^/]*$", 1))).select("page_id")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45")
def project_select_exprs(lineitem):
    return O.build(O.with_where("l_quantity > 45"), O.with_select("l_orderkey", "l_linenumber", "round(l_extendedprice * (1 - l_discount), 4) AS net", "upper(l_returnflag) AS flag")).apply(lineitem)


@query("SELECT doc_id, coalesce(text, '') <> '' AND trim(doc_id::VARCHAR) <> '' AS usable FROM documents")
def predicate_not_blank(documents):
    return documents.select("doc_id", ((F.coalesce("text", F.lit("")) != "") & (F.trim(F.col("doc_id").cast("string")) != "")).alias("usable"))


@query("SELECT doc_id FROM documents WHERE regexp_replace('.' || lang, '^\\.', '') = 'de' AND source = 'src1'")
def post_filter_language(documents):
    rows = documents.select("doc_id", "source", X.strip_dot(F.concat(F.lit("."), "lang")).alias("language"))
    return rows.where("language = 'de' AND source = 'src1'").select("doc_id")


# --- aggregation


@query("SELECT count(*) AS n FROM documents WHERE lang = 'fr'")
def count_where(documents):
    return O.build(O.with_condition("lang", "fr")).number(documents)


@query("SELECT count(DISTINCT doc_id) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def count_distinct_join(documents, labels):
    return O.build(O.with_join(labels, "doc_id"), O.with_condition("toxic", 0)).number(documents, distinct="doc_id")


@query("SELECT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS found")
def exists_flag(labels):
    return labels.where("toxic = 1").limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT coalesce(max(l_orderkey), 0) AS m, coalesce(max(CASE WHEN l_quantity < 0 THEN l_orderkey END), 0) AS none FROM lineitem")
def max_default(lineitem):
    return lineitem.agg(F.coalesce(F.max("l_orderkey"), F.lit(0)).alias("m"), F.coalesce(F.max(F.when(F.col("l_quantity") < 0, F.col("l_orderkey"))), F.lit(0)).alias("none"))


@query("SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM documents")
def paginate_meta(documents):
    return documents.agg(F.count("*").alias("total")).withColumn("pages", O.pagination_meta(F.col("total"), O.parse_pagination(None, None)[1]))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


@query(f"""WITH l AS ({_LINES}), m AS (SELECT * FROM l WHERE regexp_matches(content, 'tion.*ing') ORDER BY doc_id, line LIMIT 1000),
s AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS seq FROM m)
SELECT doc_id, min(seq) AS first_seq, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY seq) AS lines FROM s GROUP BY doc_id ORDER BY first_seq LIMIT 10""")
def grep_lines_grouped(documents):
    found = retrieval.grep(documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "tion.*ing", most_files=10)
    return found.select(F.col("path").alias("doc_id"), "first_seq", F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda m: m["line"].cast("string")), ",").alias("lines"))


#: Patterns with literals, alternatives, classes, repeats, anchors and none of these.
PATTERNS = ("heed", "(?i)THE (that|thnt|thing)", "^[A-Z][a-z]+ de ", "estion?.*able$", "[0-9]{4}-[0-9]{2}", "a.b|ññ", "(lyn|ndr)e+a", " tion[ ,.]", "x*y", r"ing\.")


@query(" UNION ALL ".join(f"SELECT {n} AS pattern, doc_id, line::INT AS line, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(content, '{p}')" for n, p in enumerate(PATTERNS)))
def grep_indexed(documents):
    """All matching lines of ten patterns, by the trigram index of the table."""
    files = documents.select("doc_id", "text")
    index = shared_grep(documents, "doc_id", "text")
    found = [index.matching_lines(files, p, path="doc_id", content="text").select(F.lit(n).alias("pattern"), "doc_id", "line", "content") for n, p in enumerate(PATTERNS)]
    return R.reduce_union(found)



@query("""WITH o AS (SELECT *, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_quantity = 50)
SELECT l_suppkey AS path, min(seq) AS first_seq, count(*) AS n FROM o GROUP BY l_suppkey ORDER BY first_seq, path LIMIT 5""")
def group_collect_capped(lineitem):
    rows = lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("content"))
    return R.group_by_file(rows, 5).select("path", "first_seq", F.size("matches").cast("long").alias("n"))


@query("SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang <> ''")
def group_by_language(documents):
    """Every document with a language, as rows of its group, and the group's size."""
    rows = documents.where("lang <> ''").select("lang", "doc_id")
    return rows.join(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang")


@query("SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1")
def primary_language_mode(documents):
    return documents.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1).select("lang")


@query("""SELECT c_custkey, coalesce(o.n, 0) AS commits, coalesce(l.n, 0) AS files FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey""")
def repo_summary_counts(customer, orders, lineitem):
    commits = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    files = lineitem.select(F.col("l_orderkey").alias("o_orderkey")).join(commits, "o_orderkey")
    return R.repository_summary(customer.select("c_custkey"), "c_custkey", {"commits": commits, "files": files})


_STATES = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'failed' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'started' ELSE 'completed' END ELSE 'completed' END"


@query(f"""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type IS NOT DISTINCT FROM 'view' AS queued, {_STATES} AS state, ts AS updated_at, 'event ' || event_id AS error FROM events),
a AS (SELECT user_id, day, count(*) FILTER (queued OR state IN ('started', 'in_progress')) AS active, count(*) FILTER (NOT queued AND state = 'failed') AS failed, count(*) FILTER (NOT queued AND state IN ('completed', 'skipped')) AS done,
  arg_max(error, struct_pack(a := updated_at, b := error)) FILTER (NOT queued AND state = 'failed') AS err FROM e GROUP BY user_id, day)
SELECT user_id, day, CASE WHEN active > 0 THEN 'in_progress' WHEN failed > 0 AND done > failed THEN 'completed_with_errors' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN active = 0 AND failed > 0 THEN err END AS message FROM a""")
def status_rollup(events):
    """Every event, by user and day: a view waits in the queue, any other event is a state."""
    day, queued = F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").eqNullSafe("view")
    rows = events.where(~queued).select("user_id", day, F.expr(_STATES).alias("state"), F.col("ts").alias("updated_at"), F.concat(F.lit("event "), "event_id").alias("error"))
    return R.status_rollup(rows, ["user_id", "day"], events.where(queued).select("user_id", day)).select("user_id", "day", "status", "message")


@query("SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n FROM events WHERE try_cast(props::JSON ->> '$.k' AS BIGINT) IS NOT NULL GROUP BY 1")
def pending_by_payload(events):
    return events.select(X.payload_number(F.col("props"), "k").alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_type = 'error' OR event_type = 'view' AS batch, round(avg((event_type = 'error')::INT), 6) AS rate, avg((event_type = 'error')::INT) > 0.05 AS fails FROM events GROUP BY 1")
def failure_rate_gate(events):
    failed = F.col("event_type") == "error"
    out = events.groupBy((failed | (F.col("event_type") == "view")).alias("batch")).agg(R.rate(failed).alias("rate"))
    return out.select("batch", F.round("rate", 6).alias("rate"), (F.col("rate") > ingest.TOLERANCE).alias("fails"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(least(greatest(count(*) FILTER (l_linestatus = 'F') * 100.0 / count(*), 0), 100), 6) END AS percent FROM lineitem GROUP BY l_orderkey""")
def completion_percent(lineitem):
    done = lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("total"))
    return done.select("l_orderkey", F.round(R.completion_percent(F.col("done"), F.col("total")), 6).alias("percent"))


@query("SELECT source, substr(sha256(string_agg(lpad(doc_id::VARCHAR, 8, '0') || coalesce(text, ''), '' ORDER BY lpad(doc_id::VARCHAR, 8, '0'))), 1, 40) AS hash FROM documents GROUP BY source")
def dir_content_hash(documents):
    return R.directory_hash(documents.select("source", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"), "text"), ["source"], "path", "text")


@query("SELECT quality, toxic, long, count(*) AS n FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic, max((n_chars > 2000)::INT) AS long FROM labels JOIN documents USING (doc_id) GROUP BY doc_id) GROUP BY ALL")
def membership_breakdown(labels, documents):
    flags = labels.join(documents.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("long")), "doc_id")
    return R.membership(flags, "doc_id", ["quality", "toxic", "long"])


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(events):
    exact = R.exact_percentiles(events, "event_type", "value", {"p50": "0.5", "p95": "0.95", "p99": "0.99"})
    return exact.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT event_type, count(*) AS n, true AS p50_near, true AS p95_near, true AS users_near, 1 AS read_last FROM events GROUP BY event_type")
def sketch_quantiles(events):
    """Sketches of two files, the second one taken in later and alone: ranks within 1 %, distinct users within 3 %, of the true ones."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/lodestone-sketches-{uuid.uuid4().hex}"
    table = SketchTable(M.TableStore(spark, f"{folder}/store"), "by_type", ["event_type"], "value", "user_id")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        read = table.refresh(spark.read.parquet(f"{folder}/events"))
    got = table.quantiles([0.5, 0.95]).withColumnsRenamed({"event_type": "_type", "n": "_n"})
    # at most one row an event type
    met = events.join(F.broadcast(got), F.col("event_type") == F.col("_type"))
    rank = lambda q: F.count_if(F.col("value") <= F.col(q)) / F.count("value")
    near = lambda q, p: (F.abs(rank(q) - p) <= 0.01)
    users = F.countDistinct("user_id")
    out = met.groupBy("event_type").agg(F.max("_n").alias("n"), near("q0", 0.5).alias("p50_near"), near("q1", 0.95).alias("p95_near"), (F.abs(F.max("distinct") - users) <= F.greatest(F.lit(1.0), users * 0.03)).alias("users_near"))
    return out.withColumn("read_last", F.lit(read))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(lineitem):
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("SELECT toxic, round(avg(quality), 6) AS resolve_rate, count(*) AS instances, sum(quality) AS resolved FROM labels GROUP BY toxic")
def benchmark_rates(labels):
    out = labels.groupBy("toxic").agg(R.rate(F.col("quality") == 1).alias("r"), F.count("*").alias("instances"), F.sum("quality").alias("resolved"))
    return out.select("toxic", F.round("r", 6).alias("resolve_rate"), "instances", "resolved")


# --- joins


@query("SELECT d.doc_id, quality FROM (SELECT doc_id, doc_id::VARCHAR AS snippet_id FROM documents) d JOIN labels l ON d.snippet_id::BIGINT = l.doc_id")
def join_cast_key(documents, labels):
    results = documents.select(F.col("doc_id").cast("string").alias("snippet_id"))
    return R.hydrate(results, labels, "snippet_id", "doc_id").select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3)")
def join_two_hop_filter(lineitem, orders, customer):
    chosen = orders.join(customer.where("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return lineitem.join(chosen.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_allowlist(documents, labels):
    return R.allowed_only(documents, labels.where("toxic = 1"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new(documents, labels):
    return R.new_only(documents, labels, "doc_id").select("doc_id")


@query("SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0")
def join_distinct_commit(documents, labels):
    return documents.join(labels.where("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey WHERE l_quantity > 48""")
def hydrate_star_left(lineitem, orders, customer, nation):
    rows = lineitem.where("l_quantity > 48").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name")


@query("""SELECT p.conv_id, p.turn, count(*) AS n, string_agg(r.turn::VARCHAR || ':' || length(r.text), ',' ORDER BY r.turn) AS replies
FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn > p.turn WHERE p.role = 'user' AND r.role = 'assistant' GROUP BY p.conv_id, p.turn""")
def related_grouped_lists(conversations):
    p = conversations.where("role = 'user'").select("conv_id", "turn")
    r = conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t"), F.length("text").alias("len"))
    out = p.join(r, "conv_id").where("t > turn").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("t", "len"))).alias("x"))
    return out.select("conv_id", "turn", "n", F.array_join(F.transform("x", lambda s: F.concat(s["t"].cast("string"), F.lit(":"), s["len"].cast("string"))), ",").alias("replies"))


@query("""WITH b AS (SELECT user_id, ts AS start, max(event_id) AS page FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT e.event_id, b.page FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.start""")
def asof_page_lookup(events):
    bounds = events.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("event_id").alias("page"))
    return R.as_of(events.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), "ts", bounds, "start", "page", ["user_id"]).select("event_id", "page")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
s AS (SELECT doc_id, line, coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
o AS (SELECT doc_id, unnest(generate_series(0, strlen(coalesce(text, '')), 200)) AS at FROM documents)
SELECT o.doc_id, o.at AS "offset", s.line FROM o ASOF JOIN s ON o.doc_id = s.doc_id AND o.at >= s.start""")
def line_of_offset(documents):
    """The lines of byte offsets 0, 200, 400 and so on, to the end of every text."""
    rows = documents.select("doc_id", F.explode(X.lines_at(F.col("text"), 200)).alias("at"))
    return rows.select("doc_id", F.col("at.offset").cast("long").alias("offset"), F.col("at.line").cast("long").alias("line"))


@query("SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def self_join_parent(conversations):
    parent = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return conversations.select("conv_id", "turn").join(parent, ["conv_id", "turn"], "left")


@query("""WITH k AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT p_brand FROM part)
SELECT name, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_name = name), (SELECT min(r_regionkey) FROM region WHERE r_name = name)) AS resolved FROM k""")
def ref_resolution_priority(nation, region, part):
    keys = nation.select(F.col("n_name").alias("name")).union(region.select("r_name")).union(part.select("p_brand")).distinct()
    return R.resolve_first(keys, "name", [(nation, "n_name", "n_nationkey"), (region, "r_name", "r_regionkey")])


@query("""WITH a AS (SELECT doc_id, quality = 1 AS s FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic = 1 AS s FROM labels WHERE doc_id % 3 <> 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN coalesce(a.s, false) AND coalesce(b.s, false) THEN 'both' WHEN coalesce(a.s, false) THEN 'left_only' WHEN coalesce(b.s, false) THEN 'right_only' ELSE 'neither' END AS bucket
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def full_outer_buckets(labels):
    a = labels.where("doc_id % 3 <> 0").select("doc_id", (F.col("quality") == 1).alias("solved"))
    b = labels.where("doc_id % 3 <> 1").select("doc_id", (F.col("toxic") == 1).alias("solved"))
    return R.full_outer_buckets(a, b, "doc_id", "solved")


# --- ranking, order, sets


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(orders):
    return R.latest_per_key(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM documents")
def prefix_sum_offsets(documents):
    return R.prefix_offsets(documents.select("doc_id", "n_chars"), "doc_id", "n_chars", tie="n_chars").select("doc_id", "first")


@query("SELECT user_id, event_id, 2000 + 10 * (count(*) OVER (PARTITION BY user_id) - (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)) AS priority FROM events")
def priority_assignment(events):
    return R.assign_priorities(events.select("user_id", "event_id"), ["user_id"], F.col("event_id"), 2000).select("user_id", "event_id", "priority")


@query("SELECT event_id, value, ts FROM events ORDER BY round(value) DESC, ts, event_id LIMIT 20")
def topk_priority_order(events):
    return events.orderBy(F.round("value").desc(), "ts", "event_id").limit(20).select("event_id", "value", "ts")


@query("SELECT nationkey, min_by(name, o) AS name FROM (SELECT s_nationkey AS nationkey, min(s_name) AS name, 0 AS o FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, min(c_name), 1 FROM customer GROUP BY 1) GROUP BY nationkey")
def union_first_wins(supplier, customer):
    s = supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.min("s_name").alias("name"))
    c = customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.min("c_name").alias("name"))
    return R.first_wins([s, c], "nationkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect_scope(orders):
    return orders.where("o_orderstatus = 'O'").select("o_custkey").intersect(orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_orderkey FROM orders EXCEPT SELECT max(o_orderkey) FROM orders GROUP BY o_custkey")
def set_except_old(orders):
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return orders.select("o_orderkey").exceptAll(latest)


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AND (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) = 0 AS same")
def set_equality(customer, nation):
    a, b = customer.select(F.col("c_nationkey").alias("k")).distinct(), nation.select(F.col("n_nationkey").alias("k")).distinct()
    sides = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), "k", "full_outer")
    return sides.agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same"))


@query("SELECT event_id, user_id, lag(event_id) OVER w AS before, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", F.lag("event_id").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"))


# --- text


@query("""SELECT doc_id, s AS start, substr(text, s + 1, 300) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 250)) AS s FROM documents WHERE length(text) > 0)
WHERE s = 0 OR length(substr(text, s + 1, 300)) > 50""")
def char_window_chunks(documents):
    return ingest.window_chunks(documents, 300, 50, "doc_id", "text").select("doc_id", F.col("start").cast("long").alias("start"), "chunk")


@query()
def text_chunks_full(documents):
    return ingest.chunk_files(documents, key="doc_id", content="text")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, least(coalesce(n_chars, 0), 4000) AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0::BIGINT AS batch, 1 AS held, w AS chars FROM d WHERE i = 1
UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN r.held >= 4 OR r.chars + d.w > 4000 THEN r.batch + 1 ELSE r.batch END,
  CASE WHEN r.held >= 4 OR r.chars + d.w > 4000 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held >= 4 OR r.chars + d.w > 4000 THEN d.w ELSE r.chars + d.w END FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.i = r.i + 1)
SELECT source, doc_id, batch FROM r""")
def token_budget_batches(documents):
    """Every document in order of its id; a null length counts as 0, and one of 4000 or more fills a batch alone."""
    return R.carried_batches(documents, "source", "doc_id", "n_chars", 4000, 4)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^[^/]*//[^/]*example\\.net/(?:[^/]*/)*[^/]*1[^/]$')")
def glob_match_urls(pages):
    return pages.where(X.glob_match(F.col("url"), "*//*example.net/**/*1?")).select("page_id", "url")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(a) >= 1 THEN a[1:2] ELSE [] END || CASE WHEN len(a) >= 4 THEN ['...'] || a[4:4] ELSE [] END || CASE WHEN len(a) >= 6 THEN ['...'] || a[6:7] ELSE [] END, chr(10)) AS part FROM l""")
def line_slice(documents):
    return documents.select("doc_id", X.pick_lines(F.col("text"), X.parse_lines("L1-L2,L4,L6-L7")).alias("part"))


@query("SELECT doc_id, array_to_string([i::VARCHAR || chr(9) || a[i] for i in generate_series(2, least(3, len(a)))], chr(10)) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def line_numbers(documents):
    return documents.select("doc_id", X.pick_lines(F.col("text"), X.parse_lines("L2-L3"), numbered=True).alias("part"))


@query("""SELECT page_id, regexp_extract(p, '\\.([^./]*)$', 1) AS ext, CASE regexp_extract(p, '\\.([^./]*)$', 1) WHEN 'html' THEN 'html' ELSE regexp_extract(p, '\\.([^./]*)$', 1) END AS lang,
CASE regexp_extract(p, '\\.([^./]*)$', 1) WHEN 'html' THEN 'text/html' ELSE 'text/plain' END AS mime FROM (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS p FROM pages)""")
def path_ext_lang_mime(pages):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return pages.select("page_id", X.extension(path).alias("ext"), X.language_of(path).alias("lang"), X.media_type(X.extension(path)).alias("mime"))


@query("SELECT page_id, regexp_replace(replace(url, '://', '://user:secret@'), '//[^@/]*@', '//') AS clean FROM pages")
def url_sanitize(pages):
    return pages.select("page_id", X.sanitize_uri(F.replace(F.col("url"), F.lit("://"), F.lit("://user:secret@"))).alias("clean"))


@query("SELECT doc_id, substr(text, 1, 40) AS head, strlen(text) > 2000 AS large FROM documents")
def rune_truncate(documents):
    return documents.select("doc_id", X.truncate(F.col("text"), 40).alias("head"), (F.octet_length("text") > 2000).alias("large"))


_CUT = "coalesce(" + ", ".join(f"try(decode(array_slice(encode(text), 1, {{0}} - {k})))" for k in range(4)) + ")"


@query("WITH d AS (SELECT doc_id, text AS whole, CASE WHEN strlen(text) > 1000 THEN " + _CUT.format(1000) + " ELSE text END AS cut, strlen(text) > 1000 AS long FROM documents) SELECT doc_id, length(cut) AS n, strlen(cut) AS bytes, sha256(cut || CASE WHEN long THEN '[cut]' ELSE '' END) AS digest, strlen(whole) > 100000 AS large FROM d")
def byte_cut(documents):
    """Every text cut to 1000 bytes, where a character would be split before it: characters, bytes and digest of what is left."""
    cut, noted = X.truncate_bytes(F.col("text"), 1000, ""), X.truncate_bytes(F.col("text"), 1000, "[cut]")
    return documents.select("doc_id", F.length(cut).cast("long").alias("n"), F.octet_length(cut).cast("long").alias("bytes"), F.sha2(noted, 256).alias("digest"), (F.octet_length("text") > 100_000).alias("large"))


@query("SELECT event_id, event_type || ':' || (props::JSON ->> '$.k') AS key FROM events")
def dedup_key_from_json(events):
    return events.select("event_id", X.dedup_key(F.col("event_type"), F.col("props")).alias("key"))


@query("SELECT doc_id, sha256(text) AS id, substr(sha256(text), 1, 8) AS short FROM documents")
def sha256_ids(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("id"), X.short_sha(F.sha2("text", 256)).alias("short"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') AS links, regexp_replace(html, 'href=\"/([^\"]*)\"', 'href=\"/wiki/\\1\"', 'g') AS rewritten FROM pages")
def links_extract_rewrite(pages):
    links = F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), " ")
    return pages.select("page_id", links.alias("links"), F.regexp_replace("html", 'href="/([^"]*)"', 'href="/wiki/$1"').alias("rewritten"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE strlen(text) END AS bytes FROM documents WHERE text IS NOT NULL")
def binary_probe(documents):
    mark = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(mark, F.encode("text", "UTF-8"))
    return documents.where("text IS NOT NULL").select("doc_id", F.octet_length(X.decode_unless_binary(content)).cast("long").alias("bytes"))


@query("""WITH c AS (SELECT 'p_name' AS col, p_name AS v FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT 'p_brand', p_brand FROM part)
SELECT col, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (trim(v) <> '') AS numeric, count(DISTINCT trim(v)) FILTER (trim(v) <> '') AS n FROM c GROUP BY col""")
def csv_profile(part):
    long = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in ("p_name", "p_size", "p_brand")])).alias("x")).select("x.col", "x.v")
    filled = long.where(F.trim("v") != "")
    return filled.groupBy("col").agg(F.bool_and(F.col("v").try_cast("double").isNotNull()).alias("numeric"), F.count_distinct(F.trim("v")).alias("n"))


@query("""WITH r AS (SELECT user_id, event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT user_id, string_agg(x, ' ' ORDER BY k, x) AS vs FROM (SELECT DISTINCT user_id, 1 AS k, day AS x FROM r UNION SELECT DISTINCT user_id, 2, event_type FROM r) GROUP BY user_id),
t AS (SELECT user_id, string_agg(day || ',' || event_type || ',' || n, chr(10) ORDER BY day, event_type) AS top FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_type) <= 5) GROUP BY user_id)
SELECT user_id, 'Headers: day kind n' || chr(10) || 'Values: ' || vs || chr(10) || 'Top rows:' || chr(10) || top AS summary FROM v JOIN t USING (user_id)""")
def csv_summaries(events):
    """A CSV file for each user (a row a day and kind of event), summarised as a file of a repository is."""
    rows = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("day", "event_type", F.col("count").cast("string").alias("n")))), lambda r: F.concat_ws(",", r["day"], r["event_type"], r["n"]))
    files = rows.groupBy("user_id").agg(F.encode(F.concat(F.lit("day,kind,n\n"), F.array_join(lines, "\n")), "UTF-8").alias("content"))
    return document_pages(files.select("user_id", F.lit("csv").alias("extension"), "content"), "user_id").select("user_id", F.col("text").alias("summary"))


@query("""WITH t AS (SELECT doc_id, text, string_split(text, chr(10))[1:100] AS l, len(regexp_extract_all(text, 'the ')) + len(regexp_extract_all(text, 'ing ')) AS n FROM documents)
SELECT doc_id, n::BIGINT AS n, CASE WHEN n >= 3 THEN array_to_string([x for x in l if contains(trim(x), 'the ') OR contains(trim(x), 'ing ')], chr(10)) ELSE '' END AS api FROM t""")
def api_line_extract(documents):
    marks = ("the ", "ing ")
    return documents.select("doc_id", X.indicator_count(F.col("text"), marks).cast("long").alias("n"), X.api_lines(F.col("text"), marks).alias("api"))


# --- retrieval

_TERMS = "SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)"
_STATS = "s AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT doc_id, any_value(dl) AS dl FROM t GROUP BY doc_id))"


def _bm25_sql(k: int) -> str:
    return f"""SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM h JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id::VARCHAR LIMIT {k}"""


@query(f"WITH t AS ({_TERMS}), {_STATS} SELECT (SELECT n FROM s) AS documents, round((SELECT mean FROM s), 6) AS mean, count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS postings FROM t")
def bm25_build(documents):
    """The stored index of all documents, built anew: what it holds."""
    index = shared_index(documents, "doc_id", "text", "words", rebuild=True)
    rows = index.store.read("postings").groupBy("term").agg(F.sum("n").alias("n")).agg(F.count("*").alias("terms"), F.sum("n").alias("postings"))
    return index.stats().select(F.col("n").alias("documents"), F.round("mean", 6).alias("mean")).join(rows)


def _found(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH t AS ({_TERMS}), {_STATS}, h AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM t WHERE term IN ('tion', 'the', 'worthless') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(10)})""")
def bm25_terms_topk(documents):
    return _found(shared_index(documents, "doc_id", "text", "words").find("tion the worthless", 10, phrase=False))


@query(f"""WITH p AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i, len(t) AS dl FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)),
t AS (SELECT doc_id, dl FROM p), {_STATS}, h AS (SELECT a.doc_id, 'x' AS term, any_value(a.dl) AS dl, count(*) AS tf FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(10)})""")
def bm25_phrase_topk(documents):
    return _found(shared_index(documents, "doc_id", "text", "words").find("of the", 10))


def _forms(word: str) -> str:
    """A SQL list of the words that have this word's stem: the stem and all endings the stemmer takes off, one or two deep."""
    root, ends = stem(word), ["", *ENDINGS]
    tried = {base + a + b for base in {root, root[:-1], root + "e", root.rstrip("i") + "y"} for a in ends for b in ends}
    return ", ".join(f"'{w}'" for w in sorted(tried) if stem(w) == root)


_BAG = f"SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: NOT list_contains({sorted(w for w in STOP_WORDS if w.isalpha())!r}, x)) AS t FROM documents"


@query(f"""WITH d AS ({_BAG}), t AS (SELECT doc_id, unnest(t) AS word, len(t) AS dl FROM d), {_STATS},
h AS (SELECT doc_id, CASE WHEN word IN ({_forms("disgusting")}) THEN 'a' WHEN word IN ({_forms("thanked")}) THEN 'b' WHEN word IN ({_forms("worthless")}) THEN 'c' END AS term, any_value(dl) AS dl, count(*) AS tf FROM t WHERE term IS NOT NULL GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(20)})""")
def bm25_stemmed_topk(documents):
    """A bag of words without stop words, by stems; the SQL lists the words of each stem."""
    return _found(shared_index(documents, "doc_id", "text", "bag").find("The disgusting thanked, and worthless", 20, phrase=False))


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (3, 5, 7, 11) AND trim(text) <> ''")
def keyword_lookup(documents):
    """What a search without a query finds: the ids that are indexed."""
    return _found(shared_index(documents, "doc_id", "text", "words").lookup(["3", "5", "7", "11", "none"]))


@query(f"""WITH t AS ({_TERMS}), {_STATS}, h AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM t WHERE term IN ('tion', 'the') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM h JOIN f USING (term), s WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY doc_id ORDER BY score DESC, doc_id::VARCHAR LIMIT 10)""")
def bm25_filtered_topk(documents, labels):
    """Filters restrict what is found; frequencies and lengths stay those of the whole index."""
    allowed = labels.where("toxic = 0").select(F.col("doc_id").cast("string").alias("id"))
    return _found(shared_index(documents, "doc_id", "text", "words").find("tion the", 10, allowed, phrase=False))


def _query_vector(embeddings: DataFrame) -> list[float]:
    return embeddings.where("vec_id = 7").select("embedding").first()["embedding"]


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk(embeddings):
    return retrieval.exact_topk(embeddings, _query_vector(embeddings), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk_filtered(embeddings):
    rows = embeddings.where(O.Filters(types=(1, 2)).predicate({"types": "label"}))
    return retrieval.exact_topk(rows, _query_vector(embeddings), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_allowlist(embeddings, labels):
    allowed = labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return retrieval.exact_topk(embeddings, _query_vector(embeddings), 10, "vec_id", allowed=allowed).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, vec_id LIMIT 10 OFFSET 5")
def min_score_offset_search(embeddings):
    return retrieval.exact_topk(embeddings, _query_vector(embeddings), 10, "vec_id", least=0.1, skip=5).select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) - 1 AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank < 5""")
def cosine_batch_queries(embeddings):
    """A twentieth of all vectors as queries against all of them."""
    queries = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.batch_topk(embeddings, queries, 5, "vec_id").select("query_id", "vec_id", "rank")


@query()
def ivf_topk(embeddings):
    """The stored inverted file, of which a query reads the partitions of its nearest lists."""
    return shared_vectors(embeddings, "vec_id").find(_query_vector(embeddings), 10)


@query(f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20),
b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20)
SELECT vec_id::VARCHAR AS id, round(sum(1 / (60.0 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY sum(1 / (60.0 + r)) DESC, id LIMIT 10""")
def rrf_fuse(embeddings):
    near = retrieval.exact_topk(embeddings, _query_vector(embeddings), 20, "vec_id")
    first = embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    lists = retrieval.with_rank(near, 0, "vec_id").unionByName(retrieval.with_rank(first, 1, "vec_id"))
    return retrieval.fuse(lists, "vec_id", 10).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH t AS ({_TERMS}), {_STATS}, h AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM t WHERE term IN ('thing', 'tion') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) - 1 AS r FROM ({_bm25_sql(20)})),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id::VARCHAR) - 1 AS r FROM (SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20)),
u AS (SELECT id, sum(1 / (60.0 + r)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id ORDER BY score DESC, id::VARCHAR LIMIT 10)
SELECT d.doc_id, d.lang, d.source, round(u.score, 9) AS score FROM u JOIN documents d ON d.doc_id = u.id""")
def hybrid_search(documents, embeddings):
    near = retrieval.exact_topk(embeddings, _query_vector(embeddings), 20, "vec_id").select(F.col("vec_id").alias("id"), "score")
    words = shared_index(documents, "doc_id", "text", "words").find("thing tion", 20, phrase=False).select(F.col("id").cast("long").alias("id"), "score")
    return retrieval.hybrid([near, words], documents.select("doc_id", "lang", "source"), 10, "id", "doc_id").select("doc_id", "lang", "source", F.round("score", 9).alias("score"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:[^/]*/)*en/[^/]*$') ORDER BY url LIMIT 20")
def ls_latest(pages):
    return retrieval.listing(pages.select("page_id", "url"), "**/en/*", path="url")


# --- changes


@query("SELECT doc_id::VARCHAR AS snippet_id, 16 AS dimension, doc_id NOT IN (SELECT doc_id FROM labels) AS fresh FROM documents WHERE trim(text) <> ''")
def embed_upsert_pipeline(documents, labels):
    """Every document that the vector table lacks is embedded and stored; labelled ones are there before."""
    rows = documents.select(F.col("doc_id").cast("string").alias("snippet_id"), "text")
    known = rows.join(labels.select(F.col("doc_id").cast("string").alias("snippet_id")).distinct(), "snippet_id", "left_semi")
    store = M.TableStore(documents.sparkSession, f"{shared_folder(documents.sparkSession)}/lodestone-vectors-{uuid.uuid4().hex}")
    model = ingest.hash_embedder(16)
    ingest.index_vectors(store, "code", known, model)
    before = store.read("vectors_code").select("snippet_id", F.lit(True).alias("known"))
    ingest.index_vectors(store, "code", rows, model)
    stored = store.read("vectors_code").join(before, "snippet_id", "left")
    return stored.select("snippet_id", F.size("embedding").alias("dimension"), F.col("known").isNull().alias("fresh"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def cascade_delete(documents, labels, embeddings):
    left = M.cascade_delete({"documents": (documents, "doc_id"), "labels": (labels, "doc_id"), "embeddings": (embeddings, "vec_id")}, labels.where("toxic = 1").select("doc_id"), "doc_id")
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey)")
def cleanup_keep_latest(orders):
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return M.keep_latest(orders, ["o_custkey"], "o_orderdate", latest).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_delete(part, lineitem):
    return M.drop_orphans(part, lineitem.where("l_quantity > 45"), "p_partkey", "l_partkey").select("p_partkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 1000000000, 'new' FROM customer WHERE c_custkey % 50 = 0")
def upsert_merge(customer):
    changes = customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("updated").alias("c_name")).union(customer.where("c_custkey % 50 = 0").select(F.col("c_custkey") + 1000000000, F.lit("new")))
    return M.upsert(customer.select("c_custkey", "c_name"), changes, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 < 4 THEN 'writer ' || c_custkey % 8 ELSE c_name END AS c_name FROM customer WHERE c_custkey % 8 < 7 UNION ALL SELECT -c_custkey, 'added by ' || c_custkey % 8 FROM customer WHERE c_custkey % 8 < 4")
def concurrent_commits(customer):
    """Four writers upsert their own customers while a fifth one deletes others and a sixth one compacts: every change is there."""
    spark = customer.sparkSession
    folder = f"{shared_folder(spark)}/lodestone-commits-{uuid.uuid4().hex}"
    M.TableStore(spark, folder).write("customer", customer.select("c_custkey", "c_name"))
    mine = lambda w: customer.where(F.col("c_custkey") % 8 == w)

    def upsert(w):
        rows = mine(w).select("c_custkey", F.lit(f"writer {w}").alias("c_name")).union(mine(w).select(-F.col("c_custkey"), F.lit(f"added by {w}")))
        M.TableStore(spark, folder).upsert("customer", rows, ["c_custkey"])

    def compact():
        try:
            M.TableStore(spark, folder).compact("customer")
        except M.Conflict:
            pass

    with ThreadPoolExecutor(6) as pool:
        done = [pool.submit(upsert, w) for w in range(4)]
        done += [pool.submit(M.TableStore(spark, folder).delete, "customer", mine(7).select("c_custkey")), pool.submit(compact)]
        for d in done:
            d.result()
    store = M.TableStore(spark, folder)
    store.compact("customer")
    return store.read("customer")


@query("""WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, doc_id AS id FROM documents WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'embeddings', vec_id FROM embeddings WHERE vec_id NOT IN (FROM gone)""")
def delete_sets(documents, labels, embeddings):
    """A cascade that writes keys alone, met on reading, over three tables in one commit."""
    spark = documents.sparkSession
    store = M.TableStore(spark, f"{shared_folder(spark)}/lodestone-deletes-{uuid.uuid4().hex}")
    store.transaction({"documents": documents.select("doc_id", "source"), "labels": labels, "embeddings": embeddings.select("vec_id", "label")})
    store.delete_from({"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}, labels.where("toxic = 1"), "doc_id")
    parts = [store.read(n).select(F.lit(n).alias("name"), F.col(k).alias("id")) for n, k in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 0), 99) AS c_nationkey FROM customer")
def backfill_default(customer):
    return M.backfill(customer.select("c_custkey", "c_nationkey"), "c_nationkey", 99)


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn AS step, turn - 1 - turn % 2 AS after FROM conversations WHERE turn > 0 UNION SELECT conv_id, turn, turn - 1 FROM conversations WHERE turn % 3 = 0 AND turn > 0),
r AS (SELECT conv_id, turn AS step, 0 AS depth FROM conversations UNION SELECT r.conv_id, e.step, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.after = r.step)
SELECT conv_id, step, max(depth)::INT AS depth FROM r GROUP BY conv_id, step""")
def topo_sort_dag(conversations):
    """Every conversation as a pipeline: a turn waits for the last turn of the pair before it, every third one also for the turn before it."""
    later = conversations.where("turn > 0")
    needs = later.select("conv_id", F.col("turn").alias("step"), (F.col("turn") - 1 - F.col("turn") % 2).alias("after")).union(later.where("turn % 3 = 0").select("conv_id", "turn", F.col("turn") - 1)).distinct()
    return depths(conversations.select("conv_id", F.col("turn").alias("step")), needs, "conv_id").select("conv_id", "step", "depth")


# --- streams, as batches


@query("SELECT user_id, max(event_id) AS event_id, w FROM (SELECT user_id, event_id, ts, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS w FROM events) t WHERE (user_id, ts, w) IN (SELECT (user_id, max(ts), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01')) FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01')) GROUP BY user_id, w")
def throttle_last_per_interval(events):
    from ..streaming.status import last_per_interval

    return last_per_interval(events, "user_id", "ts", "event_id", "1 hour").select("user_id", "event_id", "w")


@query("SELECT event_type || ':' || (props::JSON ->> '$.k') AS key, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY 1")
def queue_dedupe_latest(events):
    keyed = events.select(X.dedup_key(F.col("event_type"), F.col("props")).alias("key"), "event_id", "ts")
    return keyed.groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(events):
    return events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01')]) AS s FROM events) GROUP BY s")
def window_sliding(events):
    return events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g""")
def window_session(events):
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
