"""Scores, shards and languages of whole tables against plain versions, written from the definitions."""

import math
import re
from bisect import bisect_right
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from lodestone.llm import langid, quality, queries, sharding, toxicity

from ..conftest import SMALL
from .conftest import rows_of

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]


def in_fold(doc_id, folds, held):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == held


# --- toxicity


def plain_slot(codes, salt, buckets, places):
    h = (sum(c * p for c, p in zip(codes, places)) + salt * places[toxicity.LONGEST]) & MASK
    h ^= h >> 32
    return ((h * 0xD6E8FEB86659FD93 & MASK) >> 32) % buckets


def plain_rows(token, buckets):
    """The embedding rows of a word: its own and those of its n-grams of 3 to 5 characters between < and >."""
    places = [int(p) for p in toxicity._PLACES]
    marked = f"<{(token.strip(toxicity.EDGES) or token).lower()}>"
    whole = (crc32(marked.encode("utf-8", "surrogatepass"))) & MASK
    whole ^= whole >> 32
    rows = [((whole * 0xD6E8FEB86659FD93 & MASK) >> 32) % buckets]
    for n in (3, 4, 5):
        if len(marked) > n:
            rows += [plain_slot([ord(c) for c in marked[i : i + n]], n, buckets, places) for i in range(len(marked) - n + 1)]
    return rows


def plain_toxicity(model, text):
    values = []
    for token in (text or "").split():
        known = [float(model.row_logit[r]) for r in plain_rows(token, len(model.row_logit)) if not math.isnan(model.row_logit[r])]
        values.append(sum(known) / len(known) if known else 0.0)
    best = 0.0
    if values:
        n, width = len(values), model.window
        starts = [0] if n <= width else [*range(0, n - width, width // 2), n - width]
        best = max(sum(values[s : s + width]) / (min(n, width) + model.blank) for s in starts)
    return 1 / (1 + math.exp(-(model.bias + model.scale * best)))


def test_toxicity_scores(spark, tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, SMALL).collect()}
    assert len(got) == len(rows) and len({r["predicted"] for r in got.values()}) == 2
    for i, text, _ in rows:
        score = plain_toxicity(model, text)
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["held_out"] == in_fold(i, 5, 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    odd = [None, "", " \n ", "?!", "<<a>>", "Ünïcode ÉTÉ 中文字 😀", "w" * 3000, "a b " * 500]
    assert model.scores([t or "" for t in odd]) == pytest.approx([plain_toxicity(model, t) for t in odd], abs=1e-9)


def test_toxicity_learns_jointly():
    """Words that differ in what follows a clear insult get their logit from subwords; scores are those of whole documents."""
    docs = [f"alpha beta gamma w{k % 40} {'horribly rude' if k % 3 == 0 else 'kindly mild'} delta" for k in range(300)]
    model = toxicity.train(docs, np.array([int(k % 3 == 0) for k in range(300)]))
    low, high = model.scores(["alpha horribble delta", "alpha mildly delta"])[::-1]
    assert low < high


# --- quality


def plain_features(text):
    words = text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    raw, n = text.encode("utf-8", "surrogatepass"), len(words)
    share = lambda test: sum(1 for b in raw if test(b)) / len(raw)
    among = lambda chars: share(lambda b: b < 128 and chr(b) in chars)
    special = " \t\n\r\x0b\x0c.?,;:'\"()-"
    counts, lines = Counter(words), [s for s in text.split("\n") if s.strip()]
    pairs = set(zip(words, words[1:]))
    edges = re.findall(r"[^\w\s.,;:?'\"()\-]\S*(?:\s|$)", text)
    return [
        math.log(n), sum(map(len, words)) / n, share(lambda b: 65 <= b <= 90), share(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in special),
        share(lambda b: 48 <= b <= 57), share(lambda b: b >= 128), among(" \t\n\r\x0b\x0c"), among(".?"), len(counts) / n, len(pairs) / (n - 1) if n > 1 else 1.0, max(counts.values()) / n,
        math.log(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(w) > 15 for w in words) / n, sum(len(w) == 1 for w in words) / n, len(edges) / n, sum(w[0].isupper() for w in words) / n, among("aeiou"),
    ]


def plain_quality(model, x):
    logit = model.intercept
    for j, (edges, values) in enumerate(zip(model.edges, model.tables)):
        logit += values[bisect_right(edges.tolist(), x[j])]
    for i, j, ei, ej, values in model.pairs:
        logit += values[bisect_right(ei.tolist(), x[i])][bisect_right(ej.tolist(), x[j])]
    return 1 / (1 + math.exp(-max(-500, min(500, logit))))


def test_quality_scores(spark, tables):
    docs, labels, rows = tables
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, SMALL).collect()}
    assert len(got) == len(rows) and model.pairs
    for i, text, _ in rows:
        x = plain_features(text or "")
        assert quality.features(text or "") == pytest.approx(x, rel=1e-12, abs=1e-12)
        # the bins of the operator's own numbers: a value at an edge may differ from the plain one in its last bit
        assert got[i]["score"] == pytest.approx(plain_quality(model, quality.features(text or "")), abs=1e-9)
        assert got[i]["held_out"] == in_fold(i, 3, 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    for text in ("", " ", "a", "Ää 中 1!", "x\n\nx\n", "I O U\tq" * 700):
        assert quality.features(text) == pytest.approx(plain_features(text), rel=1e-12, abs=1e-12)


# --- sharding


def plain_draw(key, name, weight):
    """Spark's xxhash64 of two strings: the hash of one is the seed of the next."""
    h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def plain_shard(key, leaves):
    among = [x for x in leaves if x.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = {}
        for x in among:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0.0) + x.weight
        won = min(weights, key=lambda c: plain_draw(key, f"{level}:{c}", weights[c])) if len(weights) > 1 else next(iter(weights))
        among = [x for x in among if getattr(x, level) == won]
    return among[0].shard


def shards_are_right(got, rows):
    leaves, want = sharding.balanced(8), Counter()
    for i, text in rows:
        key, raw = "" if i is None else str(i), (text or "").encode()
        want[i, len(raw) + 1, crc32(raw), "key", plain_shard(key, leaves), plain_shard(key, sharding.grown(leaves))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, tables, odd):
    _, _, rows = tables
    shards_are_right(queries.op6_shard(spark, SMALL).collect(), [(i, t) for i, t, _ in rows])
    df, many = odd
    shards_are_right(sharding.shard_documents(df, rows_per_chunk=2).collect(), [(i, t) for i, t, _, _ in many])


# --- languages


def plain_ngrams(text):
    """n-grams of 1 to 3 characters of the words (runs of letters), each between two blanks, but the blank alone."""
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        found.update(gram for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (gram := padded[i : i + n]).strip())
    return found


def plain_ranking(found, length):
    return [gram for gram, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:length]]


def spelled(gram):
    """The n-gram that a number of the operator stands for."""
    return "".join(chr(c) for c in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


def plain_language(text, profiles, length):
    """The language whose profile is nearest out of place, the first by code point if several are, and its score."""
    mine = plain_ranking(plain_ngrams(text or ""), length)
    if not mine or not profiles:
        return "und", 0.0
    far = {}
    for lang in sorted(profiles):
        place = {gram: k for k, gram in enumerate(profiles[lang])}
        far[lang] = sum(abs(place[gram] - k) if gram in place else length for k, gram in enumerate(mine))
    best = min(far, key=lambda x: (far[x], x))
    return best, max(0.0, 1 - far[best] / (length * len(mine)))


def test_languages(spark, tables):
    docs, _, rows = tables
    found = {}
    for i, text, lang in rows:
        if lang is not None and not in_fold(i, 3, 1):
            found.setdefault(lang, Counter()).update(plain_ngrams(text or ""))
    profiles = {lang: plain_ranking(c, 300) for lang, c in found.items()}
    fitted = langid.fit(docs)
    assert fitted.langs == sorted(profiles) and [[spelled(g) for g in r.tolist()] for r in fitted.ranked] == [profiles[x] for x in fitted.langs]
    got = {r["doc_id"]: r for r in queries.op10_language(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = plain_language(text, profiles, 300)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-12)
        assert got[i]["held_out"] == in_fold(i, 3, 1)


def test_language_ties(spark):
    """Languages learned from equal texts are equally far: the first by code point wins."""
    docs = rows_of(spark, [(i, "ab cd ef", lang, "s") for i, lang in ((0, "zz"), (2, "aa"), (3, "mm"), (5, None))] + [(7, "ab cd", None, None), (8, "", None, None), (9, None, "aa", None)])
    fitted = langid.fit(docs)
    assert fitted.langs and all(r.tolist() == fitted.ranked[0].tolist() for r in fitted.ranked)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, fitted).collect()}
    assert got[7] == got[5] == fitted.langs[0] and got[8] == got[9] == "und"
