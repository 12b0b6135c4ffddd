"""Queries over whole tables, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import relational as R
from lodestone.plans import catalogue, dag, more  # noqa: F401

from .conftest import SMALL

TEXTS = ["", None, "one line", "a\nb\n" * 300, "ä中😀\n" * 400, "x" * 5000, "y" * 4000, "z" * 3999, "\n\n tail ", "```py\nx\n```\n<think>in</think> é\n" * 90, "b" * 1500, "c" * 400]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of documents with null, empty, multibyte and long texts; the given ones follow."""
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(k - 100, t, ("en", "de", "", None)[k % 4], ("s", None)[k % 2], None if t is None else len(t)) for k, t in enumerate(TEXTS * 2)]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.unionByName(given.select(made.columns)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def test_token_budget_batches(spark, folder, documents):
    groups = defaultdict(list)
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        groups[r["source"]].append(r)
    want = set()
    for source, rows in groups.items():
        batch, held = 0, []
        for r in rows:
            n = min(r["n_chars"] or 0, 4000)
            if held and (len(held) == 4 or sum(held) + n > 4000):
                batch, held = batch + 1, []
            held.append(n)
            want.add((source, r["doc_id"], batch))
    got = [tuple(r) for r in catalogue.QUERIES["token_budget_batches"](spark, folder).select("source", "doc_id", "batch").collect()]
    assert len(got) == len(documents) and set(got) == want


def test_group_by_language(spark, folder, documents):
    sizes = Counter(r["lang"] for r in documents if r["lang"])
    want = sorted((r["lang"], r["doc_id"], sizes[r["lang"]]) for r in documents if r["lang"])
    got = catalogue.QUERIES["group_by_language"](spark, folder).select("lang", "doc_id", "n").collect()
    assert sorted(tuple(r) for r in got) == want and max(r["n_chars"] or 0 for r in documents) > 400


def test_line_of_offset(spark, folder, documents):
    want = []
    for r in documents:
        data = (r["text"] or "").encode()
        want += [(r["doc_id"], at, data[:at].count(b"\n") + 1) for at in range(0, len(data) + 1, 200)]
    got = catalogue.QUERIES["line_of_offset"](spark, folder).select("doc_id", "offset", "line").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def cleaned(text):
    """Think blocks from each opening tag to the next closing one, lone tags, then the outer fence."""
    out, at = [], 0
    while (start := text.find("<think>", at)) >= 0 and (stop := text.find("</think>", start)) >= 0:
        out.append(text[at:start])
        at = stop + len("</think>")
    text = "".join([*out, text[at:]]).replace("<think>", "").replace("</think>", "").strip()
    if not text.startswith("```") or "\n" not in text:
        return text
    inner = text[text.index("\n") + 1 :]
    return (inner[: inner.rindex("```")] if "```" in inner else inner).strip()


def test_fence_and_thinking(spark, folder, documents):
    want = {}
    for r in documents:
        t = r["text"] or ""
        want[r["doc_id"]] = cleaned(f"<think>hm\n</think>```md\n{t}\n```" if r["doc_id"] % 2 == 0 else f"<think>{t}</think>end")
    got = catalogue.QUERIES["fence_and_thinking"](spark, folder).collect()
    assert len(got) == len(documents) and {r["doc_id"]: r["body"] for r in got} == want


def test_status_rollup(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    got = catalogue.QUERIES["status_rollup"](spark, SMALL).collect()
    assert {(r["user_id"], r["day"]) for r in got} == {(r["user_id"], str(r["ts"].date())) for r in events.collect()}
    assert {r["status"] for r in got} >= {"in_progress", "failed", "completed"}


@pytest.mark.parametrize("limit", [100_000, 1000])
def test_byte_cut(spark, limit):
    texts = [None, "", "short", "a" * limit, "a" * (limit + 1), "ä" * limit, "x" + "ä" * limit, *("y" * k + "😀" * (limit // 3) for k in range(4)), "z" * (limit - 3) + "\ufffd" + "tail", "中\n" * limit]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["k"]: (r["cut"], r["noted"]) for r in rows.select("k", X.truncate_bytes(F.col("text"), limit, "").alias("cut"), X.truncate_bytes(F.col("text"), limit, "[cut]").alias("noted")).collect()}
    for k, text in enumerate(texts):
        cut = None if text is None else text.encode()[:limit].decode(errors="ignore")
        assert got[k] == (cut, None if cut is None else cut + ("[cut]" if cut != text else "")), k


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_carried_batches(spark, parts):
    """Greedy batches over sorted ranges, however many, are those of one pass; a group can be most of the table."""
    rng = random.Random(parts)
    rows = [(rng.choice(["big", "big", "big", "a", "b", None]), k, rng.choice([None, 0, 1, 3, 5, 9, 40, 90])) for k in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, k long, w long")
        got = {(r["g"], r["k"]): r["batch"] for r in R.carried_batches(df, "g", "k", "w", 40, 5).collect()}
        sums = {r["k"]: r["first"] for r in R.prefix_offsets(df.select("k", "w"), "k", "w").collect()}
        tied = sorted(r["first"] for r in R.prefix_offsets(df.selectExpr("k % 7 AS k", "k AS t", "coalesce(w, 1) AS w"), "k", "w", tie="t").collect())
        empty = R.carried_batches(df.limit(0), "g", "k", "w", 40, 5).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, before = {}, 0
    for g in ("big", "a", "b", None):
        batch, held = 0, []
        for _, k, w in [r for r in rows if r[0] == g]:
            w = min(w or 0, 40)
            if held and (len(held) == 5 or sum(held) + w > 40):
                batch, held = batch + 1, []
            held.append(w)
            want[g, k] = batch
    assert got == want and empty == 0
    for _, k, w in rows:
        assert sums[k] == before
        before += w or 0
    order, before, offsets = sorted(rows, key=lambda r: (r[1] % 7, r[1])), 0, []
    for r in order:
        offsets.append(before)
        before += 1 if r[2] is None else r[2]
    assert tied == sorted(offsets)


def test_depths(spark):
    steps = spark.createDataFrame([(1, s) for s in "abcd"] + [(2, s) for s in "xy"] + [(3, "alone")], "p int, step string")
    needs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "c"), (1, "d", "a"), (2, "y", "x"), (2, "x", "unknown")], "p int, step string, after string")
    assert sorted(map(tuple, dag.depths(steps, needs, "p").collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "x", 0), (2, "y", 1), (3, "alone", 0)]
    with pytest.raises(ValueError):
        dag.depths(steps, needs.unionByName(spark.createDataFrame([(1, "a", "d")], needs.schema)), "p", most=9)


def test_directory_hash(spark):
    """The digest of sorted paths and bytes, folders one after the other."""
    files = [("f", f"p{k:03}", bytes([k]) * (k * 37)) for k in range(90)] + [("g", "a", b"\0\xff"), ("g", "b", None), (None, "x", b"1")]
    want = {}
    for g in ("f", "g", None):
        want[g] = hashlib.sha256(b"".join(p.encode() + (c or b"") for d, p, c in sorted(files, key=lambda r: r[1]) if d == g)).hexdigest()[:40]
    df = spark.createDataFrame(files, "d string, p string, c binary").repartition(7)
    assert {r["d"]: r["hash"] for r in R.directory_hash(df, ["d"], "p", "c").collect()} == want
