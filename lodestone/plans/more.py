"""Further entries of the query catalogue: harness statistics, text functions, status and streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..session import shared_folder
from ..streaming import status, windows
from . import retrieval
from .catalogue import ORACLES, QUERIES, query


@query("SELECT o_orderstatus AS run, round(sum(o_totalprice), 2) AS cost, count(*) AS calls, count(*) FILTER (o_totalprice > 100000) AS with_patch FROM orders GROUP BY o_orderstatus")
def run_stats(orders):
    return orders.groupBy(F.col("o_orderstatus").alias("run")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count("*").alias("calls"), F.count_if(F.col("o_totalprice") > 100000).alias("with_patch"))


@query("SELECT d.doc_id, l.quality = 1 AS resolved, length(d.text) AS patch_length FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def prediction_join(documents, labels):
    return documents.where("lang = 'en'").join(labels, "doc_id").select("doc_id", (F.col("quality") == 1).alias("resolved"), F.length("text").cast("long").alias("patch_length"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')")
def anti_join_by_association(customer, orders, lineitem):
    seen = orders.join(lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return R.new_only(customer.select("c_custkey"), seen, "c_custkey")


@query("SELECT DISTINCT n_regionkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def distinct_set(customer, nation):
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_mktsegment").distinct()


@query("SELECT c_custkey, c_name || ' <c' || c_custkey || '@x>' AS author, c_name AS name, 'c' || c_custkey || '@x' AS email FROM customer")
def author_parts(customer):
    author = X.format_author(F.col("c_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x")))
    return customer.select("c_custkey", author.alias("author"), X.author_name(author).alias("name"), X.author_email(author).alias("email"))


@query("SELECT event_id, event_type || '-' || user_id || CASE WHEN event_id % 2 = 0 THEN '' ELSE '-odd' END AS id FROM events")
def status_ids(events):
    return events.select("event_id", X.status_id(F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "").otherwise("odd")).alias("id"))


@query("SELECT page_id, sha256('GET' || chr(10) || url || chr(10) || '') AS key FROM pages")
def cache_keys(pages):
    return pages.select("page_id", X.cache_key(F.lit("GET"), F.col("url"), F.lit("")).alias("key"))


@query("SELECT doc_id, 'file://' || doc_id || '/' || lang || '/' || source || '.txt' || CASE WHEN doc_id % 3 > 0 THEN '?lines=L' || (doc_id % 3) || '-L9' ELSE '' END AS uri FROM documents")
def file_uris(documents):
    start = (F.col("doc_id") % 3).cast("int")
    return documents.select("doc_id", X.file_uri(F.col("doc_id"), F.col("lang"), F.concat("source", F.lit(".txt")), start, F.lit(9)).alias("uri"))


_BARE = "regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\x{85}\\x0B\\p{Z}]+', ''), '[\\s\\x{85}\\x0B\\p{Z}]+$', '')"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_BARE} ELSE 'end' END AS body FROM documents")
def fence_and_thinking(documents):
    """Every text, whole: in a fence after a think block (even ids), or in a think block before a word."""
    text = F.coalesce("text", F.lit(""))
    told = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>hm\n</think>```md\n"), text, F.lit("\n```"))).otherwise(F.concat(F.lit("<think>"), text, F.lit("</think>end")))
    return documents.select("doc_id", X.strip_fence(X.drop_thinking(told)).alias("body"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS raw, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[])) / 2, 6) AS scaled FROM embeddings")
def cosine_scales(embeddings):
    raw = X.cosine(F.col("embedding"), F.reverse("embedding"))
    return embeddings.select("vec_id", F.round(raw, 6).alias("raw"), F.round(X.distance_similarity(1 - raw), 6).alias("scaled"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::VARCHAR::DOUBLE) AS e FROM embeddings)
SELECT vec_id, len(e) AS dimension, round(e[1], 9) AS first, round(e[64], 9) AS last, round(list_sum(list_transform(e, lambda x, i: x * i)), 6) AS weighted FROM v""")
def vector_literals(embeddings):
    """Vectors written as text and read back."""
    back = X.parse_vector(X.vector_literal(F.col("embedding")))
    weighted = F.aggregate(F.transform(back, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return embeddings.select("vec_id", F.size(back).cast("long").alias("dimension"), F.round(F.element_at(back, 1), 9).alias("first"), F.round(F.element_at(back, 64), 9).alias("last"), F.round(weighted, 6).alias("weighted"))


@query("SELECT page_id, url LIKE '%/en/%' OR url LIKE '%.html' AS ignored FROM pages")
def ignore_rules(pages):
    return pages.select("page_id", X.ignored(F.col("url"), ["en", "*.html"]).alias("ignored"))


@query("""SELECT user_id, count(*) FILTER (s IN ('started', 'in_progress')) AS recovered FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'in_progress' ELSE 'completed' END AS s FROM events) GROUP BY user_id""")
def recover_stale_statuses(events):
    states = events.select("user_id", F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "in_progress").otherwise("completed").alias("state"), F.lit(None).cast("string").alias("error"))
    return status.recover_stale(states).groupBy("user_id").agg(F.count_if(F.col("state") == "failed").alias("recovered"))


@query("""SELECT e.vec_id, l.quality, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20) e
JOIN labels l ON l.doc_id = e.vec_id""")
def semantic_hydrated(embeddings, labels):
    vector = embeddings.where("vec_id = 7").first()["embedding"]
    top = retrieval.exact_topk(embeddings, vector, 20, "vec_id").withColumnRenamed("vec_id", "key")
    return R.hydrate(top, labels, "key", "doc_id").select(F.col("doc_id").alias("vec_id"), "quality", F.round("score", 6).alias("score"))


def _stream(name: str, sql: str, plan, mode: str) -> None:
    """Register a plan that a stream runs over ``events`` to its end, into Parquet in the shared folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, folder = f"{sf_dir}/events.parquet", f"{shared_folder(spark)}/lodestone-stream-{uuid.uuid4().hex}"
        # as a pattern, so that the table may be one file
        rows = plan(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))

        def keep(batch: DataFrame, number: int) -> None:
            # in complete mode a batch replaces the one before it; a repeated batch replaces itself
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

        rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*rows.columns)

    QUERIES[name], ORACLES[name] = run, sql


_stream(
    "stream_window_tumbling",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    lambda e: windows.tumbling(e, "ts", "6 hours", ["event_type"], {"n": F.count("*")}).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n"),
    "complete",
)
_stream(
    "stream_queue_dedupe",
    "SELECT DISTINCT event_type || ':' || (props::JSON ->> '$.k') AS key FROM events",
    lambda e: e.select(X.dedup_key(F.col("event_type"), F.col("props")).alias("key")).dropDuplicates(["key"]),
    "append",
)


def _late_stream(name: str, sql: str, plan) -> None:
    """Register a plan in append mode over ``events`` in three batches: most, a tenth, then another tenth with the second one again.

    Rows are too late by the watermark that the batch before was given, so most of the third batch is.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/lodestone-stream-{uuid.uuid4().hex}"
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
        for arrives in ("NOT IN (0, 5)", "= 5", "IN (0, 5)"):
            # a batch of the stream is what arrived together
            events.where(f"event_id % 10 {arrives}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            time.sleep(0.05)
        stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        rows = plan(stream)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        rows.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*rows.columns)

    QUERIES[name], ORACLES[name] = run, sql


_ARRIVED = """a AS (SELECT * FROM events WHERE event_id % 10 <> 0), late AS (SELECT * FROM events WHERE event_id % 10 IN (0, 5)), m AS (SELECT date_trunc('millisecond', {first}) - INTERVAL 1 HOUR AS mark FROM a WHERE event_id % 10 <> 5)"""
_late_stream(
    "stream_windows_append",
    f"""WITH {_ARRIVED.format(first="max(ts)")}, r AS (SELECT ts, event_type FROM a UNION ALL SELECT ts, event_type FROM late, m WHERE time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR > mark)
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')::VARCHAR AS start, event_type, count(*) AS n FROM r GROUP BY 1, 2
HAVING time_bucket(INTERVAL 6 HOUR, any_value(ts), TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    lambda stream: windows.tumbling(stream(), "ts", "6 hours", ["event_type"], {"n": F.count("*")}).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n"),
)
_late_stream(
    "stream_dedupe_watermark",
    f"WITH {_ARRIVED.format(first='max(ts)')} SELECT event_id FROM a UNION ALL SELECT event_id FROM late, m WHERE event_id % 10 = 0 AND ts > mark",
    lambda stream: windows.deduplicated(stream(), "ts", ["event_id"]).select("event_id"),
)
_late_stream(
    "stream_interval_join",
    f"""WITH {_ARRIVED.format(first="least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase'))")}, r AS (SELECT * FROM a UNION ALL SELECT late.* FROM late, m WHERE ts > mark)
SELECT v.event_id AS viewed, p.event_id AS bought FROM r v JOIN r p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR""",
    lambda stream: windows.within(
        stream().where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("viewed")), stream().where("event_type = 'purchase'").select("user_id", F.col("ts").alias("paid"), F.col("event_id").alias("bought")), ["user_id"], "ts", "paid", "2 HOURS"
    ).select("viewed", "bought"),
)
_EVENT = {"view": "start", "click": "progress", "purchase": "complete", "error": "fail", "signup": "skip"}
_STATE_SQL = """WITH e AS (SELECT {0}, ts, event_id, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' END AS state FROM events)
SELECT {0}, coalesce(arg_min(state, (ts, event_id)) FILTER (state IN ('completed', 'failed', 'skipped')), arg_max(state, (ts, event_id)) FILTER (state IN ('started', 'in_progress')), 'started') AS state FROM e GROUP BY {0}"""


def _states(events: DataFrame, *key: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for kv in _EVENT.items() for x in kv])
    rows = events.select(F.struct(*key).alias("id"), F.struct("ts", "event_id").alias("at"), F.element_at(named, F.col("event_type")).alias("event"))
    return status.replay(rows).select(*[F.col(f"id.{k}").alias(k) for k in key], "state")


@query(_STATE_SQL.format("user_id, props"))
def status_replay(events):
    """The state machine over all events of each user and payload: an ended state stays, else the last event decides."""
    return _states(events, "user_id", "props")


_stream("stream_latest_status", _STATE_SQL.format("user_id"), lambda e: _states(e, "user_id"), "complete")
