"""Ranked retrieval: keyword, vector, fused and hybrid search, grep and listings.

Every result carries its score and rank, and every order ends in the id, so equal scores have one
order on any cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, glob_match
from ..operators.relational import group_by_file
from ..session import ship_package, written

#: Results by default, how many times more each list of a fusion gets, and the constant of ranks.
TOP, PER_LIST, RANK_CONSTANT = 10, 2, 60
#: Robertson and Zaragoza's usual constants.
K1, B = 1.2, 0.75


def _top(k: int) -> int:
    return k if k > 0 else TOP


# --- keywords


def _plain_terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if t]


def _porter_terms(text: str) -> list[str]:
    from ..functions.stemming import stem, tokens

    return [stem(t) for t in tokens(text)]


def _bag_terms(text: str) -> list[str]:
    from ..functions.porter2 import terms

    return terms(text)


#: How a text becomes terms: words are lower-cased runs of ASCII letters and digits; porter stems these for
#: phrases; bag leaves stop words out and stems by Porter 2, for bags of words.
ANALYZERS: dict[str, Callable[[str], list[str]]] = {"words": _plain_terms, "porter": _porter_terms, "bag": _bag_terms}


def _split(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _terms(docs: DataFrame, key: str, text: str, analyzer: str) -> DataFrame:
    """(key, terms): words stay in Spark's code, the others go through Arrow batches."""
    if analyzer == "words":
        return docs.select(key, _split(text).alias("terms"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyze = ANALYZERS[analyzer]
        for batch in batches:
            rows = [analyze(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=[key, "terms"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, terms array<string>")


def postings(docs: DataFrame, key: str = "id", text: str = "text", analyzer: str = "words") -> DataFrame:
    """(key, term, dl, tf, positions): what each document holds of each term."""
    return postings_of(_terms(docs, key, text, analyzer), key)


def postings_of(analysed: DataFrame, key: str = "id") -> DataFrame:
    """The postings of documents whose terms are known: (key, terms)."""
    placed = F.transform("terms", lambda t, i: F.struct(i.alias("position"), t.alias("term")))
    rows = analysed.select(key, F.size("terms").alias("dl"), F.explode(placed).alias("p")).select(key, "dl", "p.position", "p.term")
    return rows.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def lengths(docs: DataFrame, key: str = "id", text: str = "text", analyzer: str = "words", empty: bool = False) -> DataFrame:
    """(key, dl) of documents that have terms, or of all, without laying out a posting."""
    rows = _terms(docs, key, text, analyzer).select(key, F.size("terms").alias("dl"))
    return rows if empty else rows.where("dl > 0")


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def impact(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _bm25(tf: Column, df: Column, n: Column, dl: Column, mean: Column) -> Column:
    return idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def bm25_known(hits: DataFrame, often: dict[str, int], n: int, mean: float, key: str = "id") -> DataFrame:
    """(key, score) of postings whose terms' frequencies are known, in no order."""
    df = reduce(lambda rest, t: F.when(F.col("term") == t, F.lit(often[t])).otherwise(rest), often, F.lit(0))
    score = _bm25(F.col("tf"), df, F.lit(n), F.col("dl"), F.lit(mean))
    return hits.groupBy(key).agg(F.sum(score).alias("score"))


def _corpus(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))


def _allowed(rows: DataFrame, key: str, allowed: DataFrame | None) -> DataFrame:
    return rows if allowed is None else rows.join(allowed.select(F.col(key).cast("string").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_semi")


def bm25_terms(index: DataFrame, terms: Sequence[str], k: int = TOP, key: str = "id", stats: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Best documents for a bag of terms: key, score. The filter on terms prunes the postings.

    ``stats`` is one row of n documents and their mean length; without it, they come from the postings.
    ``allowed`` restricts what is found, not what the frequencies count.
    """
    hits = index.where(F.col("term").isin(list(dict.fromkeys(terms))))
    freq = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = _allowed(hits, key, allowed).join(F.broadcast(freq), "term")  # one row a term of the query
    scored = scored.crossJoin(F.broadcast(_corpus(index, key) if stats is None else stats))  # one row
    return scored.groupBy(key).agg(F.sum(_bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("mean"))).alias("score")).orderBy(F.desc("score"), key).limit(_top(k))


def _minus(step: int):
    return lambda p: p - step


def bm25_phrase(index: DataFrame, terms: Sequence[str], k: int = TOP, key: str = "id", stats: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Best documents that hold the terms one after the other, scored as one term of that frequency."""
    if not terms:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = index.where(F.col("term").isin(list(set(terms))))
    docs = wanted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
    starts = F.element_at("at", F.lit(terms[0]))
    for step, term in enumerate(terms[1:], 1):
        following = F.coalesce(F.element_at("at", F.lit(term)), F.array().cast("array<int>"))
        starts = F.array_intersect(starts, F.transform(following, _minus(step)))
    found = docs.withColumn("tf", F.size(F.coalesce(starts, F.array().cast("array<int>")))).where("tf > 0").select(key, "dl", "tf")
    freq, known = found.agg(F.count("*").alias("df")), _corpus(index, key) if stats is None else stats
    scored = _allowed(found, key, allowed).crossJoin(F.broadcast(freq)).crossJoin(F.broadcast(known))  # one row each
    return scored.select(key, _bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("mean")).alias("score")).orderBy(F.desc("score"), key).limit(_top(k))


# --- vectors


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def exact_topk(vectors: DataFrame, query: Sequence[float] | Column, k: int = TOP, key: str = "id", embedding: str = "embedding", allowed: DataFrame | None = None, least: float | None = None, skip: int = 0) -> DataFrame:
    """The k most similar vectors: key, score. An allow-list that is given restricts, also if empty."""
    rows = vectors if allowed is None else vectors.join(allowed.select(key).distinct(), key, "left_semi")
    target = query if isinstance(query, Column) else _literal(query)
    scored = rows.select(key, cosine(F.col(embedding), target).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    ordered = scored.orderBy(F.desc("score"), key)
    return (ordered.offset(skip) if skip else ordered).limit(k)


#: Queries that go to a scan as one matrix, and how many bytes of scores a task holds.
MOST_QUERIES, SCORE_BYTES = 4096, 1 << 25


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP, key: str = "id", query_key: str = "query_id", embedding: str = "embedding", most: int = MOST_QUERIES) -> DataFrame:
    """The k most similar vectors of each query: query_key, key, score, rank from 0.

    Up to ``most`` queries go to the scan as one matrix, some vectors at a time are multiplied with it, and
    only the k best of them leave a task. More queries are taken in such blocks, each of which is scanned for
    and written before the next one is fetched, so the driver and a task hold one block of queries.
    """
    k = _top(k)
    ship_package(queries.sparkSession)
    done, held = [], []
    for row in queries.select(query_key, embedding).toLocalIterator():
        if len(held) == most:
            done.append(written(_block_topk(vectors, held, queries, k, key, query_key, embedding), "batch-topk"))
            held = []
        held.append((row[0], row[1]))
    return reduce(DataFrame.unionByName, [*done, _block_topk(vectors, held, queries, k, key, query_key, embedding)])


def _block_topk(vectors: DataFrame, held: list, queries: DataFrame, k: int, key: str, query_key: str, embedding: str) -> DataFrame:
    names = [name for name, _ in held]
    matrix = np.array([v for _, v in held], dtype=np.float64).reshape(len(held), -1 if held else 0)
    norms, rows = np.linalg.norm(matrix, axis=1), max(1, SCORE_BYTES // (8 * max(len(held), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names, q_type)
        for batch in batches:
            for at in range(0, batch.num_rows if names else 0, rows):
                some = batch.slice(at, rows)
                x = np.array(some.column(1).to_pylist(), dtype=np.float64)
                scale = np.linalg.norm(x, axis=1)[:, None] * norms[None, :]
                score = np.divide(x @ matrix.T, scale, out=np.zeros((len(x), len(names))), where=scale > 0)
                # ties with the k-th best stay, for the order by key to decide
                best = score >= np.partition(score, len(x) - k, axis=0)[len(x) - k] if len(x) > k else np.ones(score.shape, dtype=bool)
                v, q = np.nonzero(best)
                yield pa.RecordBatch.from_arrays([labels.take(pa.array(q)), some.column(0).take(pa.array(v)), pa.array(score[v, q])], names=[query_key, key, "score"])

    q_type = pa.int64() if dict(queries.dtypes)[query_key] in ("bigint", "int") else pa.string()
    kinds = f"{query_key} {'long' if q_type == pa.int64() else 'string'}, {key} {dict(vectors.dtypes)[key]}, score double"
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return vectors.select(key, embedding).mapInArrow(run, kinds).withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def probe_count(rows: int) -> tuple[int, int]:
    """Lists and probes of an inverted file over so many rows."""
    lists = max(rows // 10, 1)
    return lists, max(math.isqrt(lists), 10)


# --- fusion


def fuse(lists: DataFrame, key: str = "id", k: int = 0, constant: float = RANK_CONSTANT, slots: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (list_id, key, score, rank from 0): id, score, original_scores.

    An id that occurs twice in a list counts twice. A constant of 0 or less means the default. Order
    is by score, then by the id as text; k of 0 or less keeps all.
    """
    constant = constant if constant > 0 else RANK_CONSTANT
    named = F.col(key).cast("string").alias("id")
    agg = [F.sum(1 / (F.lit(float(constant)) + F.col("rank"))).alias("score")]
    if slots:
        last = [F.coalesce(F.max_by("score", F.when(F.col("list_id") == s, F.col("rank"))), F.lit(0.0)) for s in range(slots)]
        agg.append(F.array(*last).alias("original_scores"))
    else:
        agg.append(F.array_sort(F.collect_list(F.struct("list_id", "score"))).alias("original_scores"))
    out = lists.groupBy(named).agg(*agg).orderBy(F.desc("score"), "id")
    return out.limit(k) if k > 0 else out


def with_rank(result: DataFrame, list_id: int, key: str = "id") -> DataFrame:
    """A list of at most 2k results with its number and ranks; the window holds the list, not the table."""
    return result.withColumn("list_id", F.lit(list_id)).withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), key)) - 1)


def hybrid(lists: Sequence[DataFrame], table: DataFrame, k: int = TOP, key: str = "id", number: str = "id") -> DataFrame:
    """Ranked lists fused to k and joined with their rows: all columns of the table and score.

    No list gives no result. Ids that are not numbers are skipped.
    """
    k = _top(k)
    if not lists:
        return table.withColumn("score", F.lit(0.0)).limit(0)
    ranked = [with_rank(r.select(F.col(key).cast("string").alias("id"), "score"), n) for n, r in enumerate(lists)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    top = fuse(union, "id", k).select(F.col("id").try_cast("long").alias("_id"), "score").where("_id is not null")
    return table.join(F.broadcast(top), table[number] == top["_id"]).drop("_id")  # at most k rows


# --- lines and listings


def check_pattern(pattern: str, pathspec: str | None = None) -> None:
    re.compile(pattern)
    if pathspec and ".." in pathspec:
        raise ValueError("a path pattern must stay inside the repository")


#: What a line alone decides: the text's ends, look-around, inline flags but case, possessive and atomic parts.
_LINE_ONLY = re.compile(r"\\[AZzG]|\(\?(?!:)|[*+?}]\+")


def whole_text_filter(pattern: str) -> str | None:
    """A pattern that every text with a matching line matches as a whole; None if only its lines can tell."""
    flags, body = ("(?mi)", pattern[4:]) if pattern.startswith("(?i)") else ("(?m)", pattern)
    return None if _LINE_ONLY.search(body) else flags + body


def matching_lines(files: DataFrame, pattern: str, pathspec: str | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, content) of the lines that match, lines from 1.

    Texts without a match are dropped before their lines are laid out, where the pattern means the same
    in a text as in its lines.
    """
    check_pattern(pattern, pathspec)
    rows = files
    if (whole := whole_text_filter(pattern)) is not None:
        # a text's last line may be empty, and ^ only finds it if a line end follows
        text = F.concat(F.col(content), F.lit("\n")) if "^" in pattern else F.col(content)
        rows = rows.where(text.rlike(whole))
    if pathspec:
        rows = rows.where(glob_match(F.col(path), pathspec))
    lines = rows.select(path, F.posexplode(F.split(content, "\n", -1)).alias("position", "content"))
    return lines.where(F.col("content").rlike(pattern)).select(path, (F.col("position") + 1).alias("line"), "content")


def grouped_matches(matches: DataFrame, most_files: int = 10, most_matches: int = 1000, path: str = "path") -> DataFrame:
    """Matches (path, line, content) by file: path, first_seq, matches; at most 1000 matches and 200 files."""
    found = matches.orderBy(path, "line").limit(most_matches)
    numbered = found.withColumn("seq", F.row_number().over(Window.orderBy(path, "line")))  # at most most_matches rows
    return group_by_file(numbered, min(most_files, 200), path=path)


def grep(files: DataFrame, pattern: str, pathspec: str | None = None, most_files: int = 10, most_matches: int = 1000, path: str = "path", content: str = "content") -> DataFrame:
    """Matches by file: path, first_seq, matches; at most 1000 matches and 200 files."""
    return grouped_matches(matching_lines(files, pattern, pathspec, path, content), most_files, most_matches, path)


def listing(files: DataFrame, pattern: str, page: int = 1, size: int = 20, path: str = "path") -> DataFrame:
    return files.where(glob_match(F.col(path), pattern)).orderBy(path).offset((max(page, 1) - 1) * size).limit(size)
