"""Hard negatives, the filter audit and decontamination against brute force."""

import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as D
from lodestone.llm import filter_audit as A
from lodestone.llm import hard_negatives as N

from .conftest import rows_of


def negatives_brute(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    part = []
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(c is not None and math.isfinite(c) for c in x):
            part.append((i, [math.floor(scale * c) for c in x], label))
    out = []
    for a, (i, x, label) in enumerate(part):
        if not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for b, (j, y, other) in enumerate(part) if b != a and len(y) == len(x)]
        same = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        rest = sorted(s[:2] for s in scored if s[2] != label)
        for p, j in same:
            good = [(n, k) for n, k in rest if -p * low <= -n * 100 <= -p * high][:negatives]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(good)]
    return sorted(out)


def vectors():
    """Clusters, many equal vectors, repeated ids, ties, and rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = []
    for n in range(400):
        v = centres[n % 6] + rng.choice([0.05, 0.5]) * rng.normal(size=12)
        rows.append((n, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))))
    rows += [(1000 + k, rows[3][1], k % 3) for k in range(150)]
    rows += [(10, rows[11][1], 2), (10, rows[12][1], 2), (10, rows[10][1], rows[10][2]), (20, rows[20][1], 1)]
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2010, rows[1][1], None), (2020, [float("nan")] * 12, 1), (2030, [None] + [1.0] * 11, 1), (2040, [float("inf")] * 12, 0)]
    rows += [(3000 + k, [float(k % 3), 1.0, -1.0], k % 2) for k in range(12)] + [(4000, [0.5], 1), (4010, [], 1), (4011, [], 1), (4012, [], 0)]
    rows += [(5000 + k, [float(rng.normal() * 3e5) for _ in range(12)], k % 2) for k in range(30)]
    return rows


@pytest.mark.parametrize("tiny", [False, True])
def test_hard_negatives(spark, monkeypatch, tiny):
    if tiny:
        for name, value in {"CELL": 16, "PIECE": 20, "GROUP": 7, "LEAF": 4, "ANCHOR_LEAF": 2, "SEEDS": 1, "TOGETHER": 2}.items():
            monkeypatch.setattr(N, name, value)
        # a tile is at least 64 rows in production
        monkeypatch.setattr(N, "max", lambda *a: 20 if a[0] == 64 else max(*a), raising=False)
    rows = vectors()
    df = spark.createDataFrame([(*r, 7, "k", 0.5) for r in rows], "vec_id long, embedding array<float>, label int, rank int, node string, score double")
    if not tiny:
        df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    as_stored = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    got = N.mine_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_brute(as_stored, lambda i: i % 10 == 0)
    assert len(negatives_brute(as_stored, lambda i: i % 10 == 0)) > 500


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.mine_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert N.mine_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert N.mine_negatives(alone, F.col("vec_id") % 7 == 0).count() == 0


@given(st.integers(1, 40), st.integers(1, 60), st.integers(0, 5))
@settings(max_examples=30, deadline=None)
def test_intervals_hold(n, m, seed):
    """Every inner product lies in the interval of its leaves."""
    rng = np.random.default_rng(seed)
    x, y = (np.rint(rng.normal(size=(k, 6)) * 300) for k in (n, m))
    blocks = []
    for v in (x, y):
        order, starts = N._leaves(v, 4)
        assert sorted(order.tolist()) == list(range(len(v))) and np.diff(starts).max() <= 4
        whole = np.zeros(len(v), dtype=np.int64).tobytes()
        blocks.append(N.Block({"ids": whole, "labels": whole, "nodes": whole, "starts": starts.astype(np.int64).tobytes(), "vectors": v[order].astype(np.float32).tobytes(), "wide": False, "sought": None}))
    a, b = blocks
    low, high = N.intervals(a.centres, a.radii, b.centres, b.radii)
    products = a.x.astype(np.float64) @ b.x.astype(np.float64).T
    i, j = (np.repeat(np.arange(len(k.starts) - 1), np.diff(k.starts)) for k in blocks)
    assert (products >= low[np.ix_(i, j)]).all() and (products <= high[np.ix_(i, j)]).all()


def audit_brute(rows, labels):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails, out = [], []
    for i, t, _, source in rows:
        t = t or ""
        w = words(t)
        own = {f for f, bad in {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)}.items() if bad}
        fails.append((source or "", own, i in good, i in toxic))
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        table = {}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [r for r in mine if f in r[1] and not before & r[1]]
                table["".join(order), step + 1] = (sum(not (before | {f}) & r[1] for r in mine), len(removed), sum(f in r[1] and bool(before & r[1]) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed))
        share = {f: sum(v[1] for (o, s), v in table.items() if o[s - 1] == f) for f in "ABCDE"}
        out += [(part, o, s, *v, share[o[s - 1]]) for (o, s), v in table.items()]
    return sorted(out)


def test_audit(spark, odd, none):
    df, rows = odd
    long = " ".join(f"w{k}" for k in range(400))
    rows = [*rows, (200, long, None, "b"), (201, long, None, "b"), (202, long + " #", None, "c"), (203, long.upper(), None, "c"), (204, " ".join(["the"] * 300), None, "c"), (205, " ".join(["x"] * 5) + " É É", None, "c"), (None, long, None, ""), (105, "same", "en", "b"), (200, long, None, "b")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 206)] + [(None, 1, 1), (1, None, None), (1, 0, 0), (200, 1, 1), (204, 2, 5)]
    got = A.audit(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*columns).collect())) == audit_brute(rows, labels)
    assert A.audit(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    unlabelled = A.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost"), F.sum("removed")).first()
    assert unlabelled[0] == 0 and unlabelled[1] > 0


def test_audit_of_copies(spark):
    """A third of all rows with one text, and another third with one id."""
    rows = [(k, "one text", None, "a") for k in range(300)] + [(7, f"text {k}", None, "a") for k in range(300)] + [(1000 + k, f"other {k}", None, None) for k in range(300)]
    labels = [(7, 1, 0), (8, 0, 1)]
    got = A.audit(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    first = {(r["part"], r["filter_order"], r["step"]): r for r in got.collect()}
    assert first["a", "EABCD", 1]["removed"] == 299 and first["a", "ABCDE", 1]["removed"] == 600 and first["", "EABCD", 1]["removed"] == 0
    assert first["a", "AEBCD", 1]["good_lost"] == 301 and first["a", "EABCD", 1]["toxic_lost"] == 1


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks_brute(rows, items, width):
    windows = []
    for i, t in items:
        w = plain_words(t)
        windows += [(i, tuple(w[k : k + min(width, len(w))])) for k in range(max(1, len(w) - width + 1))] if w else []
    out = []
    for i, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(name)
        names = sorted(str(n) for n in found if n is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaky():
    rng = np.random.default_rng(8)
    words = ["la", "de", "Él", "niño", "x1", "of", "THE", "b"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(int(rng.integers(1, 30)))) for k in range(30)] + [(1, "Él x1 b"), (40, "Él, x1--B"), (41, None), (42, " !? "), (None, "no id in this one"), (43, text(90)), (30, "la"), (9, "zz " * 12)]
    rows = [(k, text(int(rng.integers(0, 60)))) for k in range(60)]
    rows += [(100 + k, f"start {text(5)}; {items[k][1]} - end") for k in range(30)] + [(200, None), (201, ""), (202, "..."), (203, "and NO id,in this one!"), (None, items[3][1]), (5, items[4][1]), (5, items[4][1]), (204, "zz" + " zz" * 30), (205, "q " * 20_000 + items[35][1])]
    return rows, items


@pytest.mark.parametrize(("width", "most"), [(4, 100_000), (4, 40), (10, 25), (3, 3)])
def test_decontaminate(spark, none, width, most):
    rows, items = leaky()
    docs = rows_of(spark, [(i, t, "en", "a") for i, t in rows]).withColumnsRenamed({"h": "ranges", "id": "items", "part": "text_hash"})
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = [tuple(r) for r in D.find_contaminated(docs, bench, width, most).collect()]
    assert sorted(got, key=str) == leaks_brute(rows, items, width)
    if most == 40:
        assert D.find_contaminated(none, bench, width, most).count() == 0
        clean = D.find_contaminated(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
        assert tuple(clean) == (0, len(rows))


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), min_size=1, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_automaton(items, words, width):
    ranges, found = D.build(list(enumerate(items)), width).find(words)
    hit, names = set(), set()
    for k, item in enumerate(items):
        size = min(width, len(item))
        grams = {tuple(item[p : p + size]) for p in range(len(item) - size + 1)}
        for p in range(len(words) - size + 1):
            if tuple(words[p : p + size]) in grams:
                hit |= set(range(p, p + size))
                names.add(k)
    assert {p for a, b in ranges for p in range(a, b)} == hit and found == names
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))


@pytest.mark.parametrize("most", [100_000, 5])
def test_remove_leaks(spark, most):
    item = "one two three four five six"
    rows = [(1, f"Before this, {item.upper()}! After that comes more of it."), (2, item), (3, None), (4, "nothing of it here"), (5, "é é é é é é one two three é é é"), (1, "other text of the id")]
    docs = rows_of(spark, [(i, t, "en", "a") for i, t in rows])
    left = D.remove_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), width=3, longest=4, most_share=0.6, most_words=most)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, "Before this, ! After that comes more of it."), (3, None), (4, "nothing of it here"), (5, rows[4][1]), (1, "other text of the id")], key=str)
