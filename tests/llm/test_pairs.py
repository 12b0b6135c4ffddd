"""Similarity joins against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import components as C
from lodestone.llm import embedding_dedup as E
from lodestone.llm import minhash as H
from lodestone.llm.common import in_tiles, join_groups

from .conftest import rows_of


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(size))))


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return sets, closure(range(len(rows)), links)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == closure(nodes, [(a, b) for a, b in edges if a != b])
    assert C.components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy).upper() if n % 5 == 0 else "  ".join(copy)))
            n += 1
    rng.shuffle(rows)
    sets, want = brute(rows, 2, 80)
    df = rows_of(spark, [(i, t, "en", "a") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in H.near_duplicates(df, 2, 80).collect()}
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k]] = min(least.get(want[k], i), i)
    assert got == {i: (len(sets[k]), least[want[k]], least[want[k]] == i) for k, (i, _) in enumerate(rows)}


def test_near_duplicates_odd(spark, odd, none):
    df, rows = odd
    got = H.near_duplicates(df, 2, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None or not r["n_shingles"]:
            assert r["component_id"] == r["doc_id"] and r["kept"]
    assert {r["component_id"] for r in got if r["doc_id"] == 3} == {3}
    assert H.near_duplicates(none).count() == 0
    kept = H.keep_one(df)
    assert kept.columns == df.columns and H.keep_one(none).count() == 0
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 101").count() == 1


def test_odd_sketch_estimate():
    rng = np.random.default_rng(2)
    for similarity in (0.8, 0.9, 0.97):
        wrong = []
        for _ in range(30):
            shared = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            extra = round(1000 * (1 - similarity) / similarity / 2)
            x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, extra, dtype=np.uint64)])) for _ in range(2))
            bits = int(np.bitwise_count(H.odd_sketch(H.minhash(x)) ^ H.odd_sketch(H.minhash(y))).sum())
            assert bits <= H.most_bits(0.8)
            wrong.append(H.estimate(bits) - similarity)
        assert abs(np.mean(wrong)) < 0.03


def cosine_brute(rows, threshold):
    def good(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    links = []
    for i, (_, x, lx) in enumerate(rows):
        for j, (_, y, ly) in enumerate(rows[:i]):
            if lx is not None and lx == ly and good(x) and good(y) and len(x) == len(y):
                if np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile", [16, 4096])
def test_embeddings(spark, tile, kind):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = []
    for n in range(260):
        v = centres[n % 12] + rng.choice([0.02, 0.1, 0.13, 0.3]) * rng.normal(size=24)
        rows.append((n, [float(np.float32(c)) for c in v * rng.choice([1e-3, 1.0, 50.0])], int(n % 3)))
    rows += [(300 + k, rows[7][1], rows[7][2]) for k in range(30)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 24, 1), (403, [float("nan")] * 24, 1), (404, [None] + [1.0] * 23, 1), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], f"vec_id long, embedding array<{kind}>, label int, n long, key string")
    links = cosine_brute([(i, None if v is None else np.array([np.nan if c is None else c for c in v], dtype=np.float32).astype(np.float64), label) for i, v, label in rows], 0.98)
    comp, count = closure(range(len(rows)), links), {}
    for a, b in links:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    want = {r[0]: (count.get(k, 0), rows[comp[k]][0], rows[comp[k]][0] == r[0]) for k, r in enumerate(rows)}
    assert {r[0]: tuple(r[1:]) for r in E.link_embeddings(df, tile=tile).collect()} == want
    assert E.link_embeddings(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)) * rng.choice([0.01, 1, 30], size=(300, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, n, e = E.quantise(u)
    back = q * s[:, None]
    bound = e[:, None] * n[None, :] + (n + e)[:, None] * e[None, :]
    assert (np.abs(u @ u.T - back @ back.T) <= bound + 1e-12).all()


def test_keep_one_of_repeated_ids(spark):
    """Of an id with several texts only the text that is a copy goes."""
    first, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, first), (5, first), (5, other), (5, other), (7, other), (8, third), (8, first + " end"), (9, third), (None, first), (5, "")]
    kept = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    need = [(1, first), (5, other), (8, third), (None, first), (5, "")]
    assert all(got.count(r) == 1 for r in need) and not {(5, first), (7, other), (9, third)} & set(got)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that repeat an id with other texts, near and far, are linked each by its own set."""
    rng = random.Random(23)
    words = [f"w{k}" for k in range(3000)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(14)]
    rows = []
    for k in range(160):
        copy = list(bases[k % 14])
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((rng.randrange(50), " ".join(copy)))
    rows += [(1, rows[0][1]), (1, " ".join(bases[3])), (2, " ".join(rng.sample(words, 60))), (2, rows[5][1]), (2, " ".join(rng.sample(words, 60))), (None, rows[0][1]), (7, ""), (7, None)]
    sets, component = brute([r if r[0] is not None else (None, None) for r in rows], 2, 80)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[component[k]] = min(least.get(component[k], i), i)
    want = [(i, len(shingle_set(t, 2)), least[component[k]] if i is not None and sets[k] else i) for k, (i, t) in enumerate(rows)]
    got = H.near_duplicates(rows_of(spark, [(i, t, "en", "a") for i, t in rows]), 2, 80).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(map(str, want))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)

    # of each group one row stays: the least id, then any of its texts; rows without id or words all stay
    groups = {}
    for k, (i, t) in enumerate(rows):
        if i is not None and sets[k]:
            groups.setdefault(component[k], []).append((i, t))
    kept = [(r["doc_id"], r["text"]) for r in H.keep_one(rows_of(spark, [(i, t, "en", "a") for i, t in rows]), 2, 80).collect()]
    rest = list(kept)
    for members in groups.values():
        first = [m for m in members if m[0] == min(i for i, _ in members)]
        assert sum(kept.count(m) for m in set(members)) == 1 and any(m in kept for m in first)
        rest = [r for r in rest if r not in set(members)]
    assert sorted(map(str, rest)) == sorted(map(str, [(None, rows[0][1]), (7, ""), (7, None)]))


def test_keep_one_loses_nothing(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcd")
    kept = H.keep_one(spark.createDataFrame([(5, a), (5, b), (3, c), (8, c), (8, d)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, c), (5, a), (5, b), (8, d)]


def test_in_tiles(spark):
    """Two rows of a group meet in exactly one pair of tiles, also in groups of many tiles."""
    rows = [(1, k) for k in range(700)] + [(2, k) for k in range(1000, 1030)] + [(3, 5000)]
    tasks, met = {}, {}
    for r in in_tiles(spark.createDataFrame(rows, "g long, u long"), ["g"], "u", 50).collect():
        assert r["i"] <= r["j"] and r["t"] in (r["i"], r["j"])
        tasks.setdefault((r["g"], r["i"], r["j"]), []).append((r["u"], r["t"]))
    assert max(map(len, tasks.values())) < 200
    for (g, i, j), members in tasks.items():
        for n, (u, t) in enumerate(members):
            for v, s in members[:n]:
                if i == j or s != t:
                    met[g, min(u, v), max(u, v)] = met.get((g, min(u, v), max(u, v)), 0) + 1
    assert len(met) == 700 * 699 // 2 + 30 * 29 // 2 and set(met.values()) == {1}


def test_embeddings_of_repeated_ids(spark):
    """Rows that repeat an id with other vectors are linked each by its own vector."""
    rows = [(7, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (7, [1.0, 0.0, 0.0]), (3, [1.0, 0.001, 0.0]), (7, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 2.0])]
    got = E.link_embeddings(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(map(tuple, got)) == sorted([(7, 1, 7, True), (9, 1, 7, False), (7, 1, 3, False), (3, 1, 3, True), (7, 1, 7, True), (7, 1, 7, True)])


def true_links(sets, percent=80):
    """All pairs of sets that reach the similarity, by an exact prefix filter."""
    often = Counter(x for s in sets for x in s)
    index, links = {}, []
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        n = len(sets[k])
        prefix = sorted(sets[k], key=lambda x: (often[x], x))[: n - -(-percent * n // 100) + 1]
        near = {j for x in prefix for j in index.get(x, ()) if 100 * len(sets[j]) >= percent * n}
        links += [(j, k) for j in near if 100 * len(sets[j] & sets[k]) >= percent * len(sets[j] | sets[k])]
        for x in prefix:
            index.setdefault(x, []).append(k)
    return links


@pytest.mark.parametrize("size", [2, 5])
def test_recall(spark, size, capsys):
    """Of all true links of the medium table, none is lost; the components are the exact ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = [shingle_set(t, size) for _, t in rows]
    links = true_links(sets)
    component = closure(range(len(rows)), links)
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(docs, size, 80).collect()}
    kept = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in links)
    with capsys.disabled():
        print(f" {size} words: {kept} of {len(links)} true links kept")
    assert kept == len(links) > 1000
    assert got == {i: rows[component[k]][0] for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("many", [10, 10_000])
def test_join_groups(spark, many):
    """The join of each row with its group, whether large groups are spread or not; rows without one go."""
    rows = [(g, u) for u in range(400) for g in ([1, 2] if u % 4 else [3])] + [(9, 1)]
    sizes = {g: sum(x == g for x, _ in rows) for g in (1, 2, 3)}
    groups = spark.createDataFrame([(g, n, f"g{g}") for g, n in sizes.items() if g != 2] + [(8, 500, "none")], "g long, _n long, name string")
    got = join_groups(spark.createDataFrame(rows, "g long, u long"), groups, "g", "u", many).collect()
    assert sorted(map(tuple, got)) == sorted((g, u, f"g{g}") for g, u in rows if g in (1, 3))
