"""Regex search: equal to matching line by line, with and without the trigram index."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.plans import grep_index as G
from lodestone.plans import retrieval

TEXTS = [
    "foo x", "bar\nfoo bar", "foo\nbar", "", None, "one line\r\nfoo\rend\n", "class Alpha:\n    def run(self):\n        return 42\n\n", "ALPHA beta\nGamma_delta 1234-56\n\n\n",
    "x = compute(alpha, beta)  # foo", "ñandú über straße\nNaïve CAFÉ", "aaa\naab\nabab abab\n", "foo\n\nfoo", "tab\there\nK foo", "no match at all", "def other():\n    pass # def again", "xfoobarx\nfoo barfoo",
]
PATTERNS = [
    r"\Afoo", r"foo\Z", r"\Abar\Z", "^foo", "foo$", "^foo$", "^$", "foo(?!\\s)", "(?<!x)foo", "(?=foo)f", "foo|bar", "(foo|bar)+x?", "def \\w+\\(", "return [0-9]+", "[Aa]lpha", "(?i)alpha", "(?i)GAMMA_d", "[0-9]{4}-[0-9]{2}", "a*b", "aa+b",
    "(ab){2} ?abab", "\\bfoo\\b", "\\Bfoo", "f.o", "f[^x]o", "fo{2}", "fo{0,1}o", "(?:foo|fob)a?r?", "über", "straße", "na.ve", "(?i)café", ".", "x.*y", "(a|b|c|d)(a|b|c|d)(a|b|c|d)", "[a-h]lpha", "[a-zA-Z]+_delta", "(foo)? bar", "(?:ab)+", "foo\\s", "\\tHere|\\there", "(.)\\1\\1",
    "a++b", "(?:alpha|beta|gamma)[^\\n]*(?:run|beta)", "comp(ute|are)\\(alpha", "(|foo)bar", "#", "\\(self\\)", "pass # def", "[f][o][o]", "(?i:foo)x", "foo\\Z|never",
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"src/f{k}.py" if k % 2 else f"lib/f{k}.go", t) for k, t in enumerate(TEXTS)], "path string, content string")


@pytest.fixture(scope="module")
def by_line(files):
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "content"))
    found = [lines.where(F.col("content").rlike(p)).select(F.lit(n).alias("n"), "path", (F.col("line") + 1).alias("line"), "content") for n, p in enumerate(PATTERNS)]
    out = {n: [] for n in range(len(PATTERNS))}
    for part in found:
        for r in part.collect():
            out[r["n"]].append((r["path"], r["line"], r["content"]))
    return {n: sorted(v) for n, v in out.items()}


def test_matching_lines(files, by_line):
    for n, p in enumerate(PATTERNS):
        assert sorted(map(tuple, retrieval.matching_lines(files, p).collect())) == by_line[n], p
    assert sum(map(len, by_line.values())) > 200


def test_index(spark, files, by_line, tmp_path):
    index = G.GrepIndex(spark, f"file://{tmp_path}")
    assert index.add(files.where("path LIKE 'src%'")) == 8 and index.add(files) == 8 and index.add(files) == 0
    read = Counter()
    for n, p in enumerate(PATTERNS):
        found = index.candidates(p)
        read["full" if found is None else "some"] += 1
        assert sorted(map(tuple, index.matching_lines(files, p).collect())) == by_line[n], p
        if found is not None:
            assert found.count() < len(TEXTS)
    assert read["some"] >= 25 and index.candidates("f.o") is None
    assert sorted(map(tuple, index.matching_lines(files, "foo", "**/*.py").collect())) == [r for r in by_line[PATTERNS.index("foo|bar")] if r[0].endswith(".py") and "foo" in r[2]]
    assert [tuple(r)[:2] for r in index.grep(files, "foo", most_files=3).collect()] == [tuple(r)[:2] for r in retrieval.grep(files, "foo", most_files=3).collect()]
    index.remove(files.where("path = 'lib/f0.go'"))
    assert "lib/f0.go" not in {r["path"] for r in index.matching_lines(files, "foo").collect()}
    assert index.candidates("zebra").count() == 0


def test_needed():
    said = lambda p: sorted(G.needed(p).grams())
    assert said("abcd") == ["abc", "bcd"] and G.needed("abc|x") == G.ANYTHING and G.needed("[^a]bc") == G.ANYTHING
    assert said("(?i)ABC") == ["abc"] and said("ab[cd]e") == ["abc", "abd", "bce", "bde"] and said("abc.*def") == ["abc", "def"]
    assert said("abcx?d") == ["abc", "bcd", "bcx", "cxd"] and said("(abc)+") == ["abc"] and G.needed("(abc)*") == G.ANYTHING
    with pytest.raises(re.error):
        G.needed("(")


def satisfied(need, grams):
    if need.kind == "gram":
        return need.gram in grams
    return (all if need.kind == "all" else any)(satisfied(p, grams) for p in need.parts)


ATOMS = st.sampled_from(["a", "b", "c", "ab", "abc", "[ab]", "[a-c]", ".", "[^a]", "\\w", "(?:ab|ba)", "(a|bc|)", "(?:abc|cab|bb)", "x?"])
REGEXES = st.recursive(ATOMS, lambda inner: st.one_of(st.builds(lambda a, b: a + b, inner, inner), st.builds(lambda a, b: f"(?:{a}|{b})", inner, inner), st.builds(lambda a, m: f"(?:{a}){m}", inner, st.sampled_from(["?", "*", "+", "{2}", "{1,3}", "{0,2}"]))), max_leaves=7)


@given(REGEXES, st.lists(st.text("abcABx ", max_size=14), min_size=1, max_size=8))
@settings(max_examples=400, deadline=None)
def test_need_holds(pattern, texts):
    """Whatever matches holds what the pattern is said to need."""
    need = G.needed(pattern)
    often = {g: len(g) + ord(g[0]) for g in need.grams()}
    for text in texts:
        if re.search(pattern, text):
            grams = {text.lower()[i : i + 3] for i in range(len(text) - 2)}
            assert satisfied(need, grams) and satisfied(G.rarest(need, often), grams)


def test_postings_are_packed(spark, tmp_path, monkeypatch):
    """A trigram is one row a piece of files, however many hold it; large pieces, many candidates and files added again change no result."""
    files = spark.range(500, numPartitions=1).selectExpr("concat('f', id) AS path", "concat('common text ', id % 50, if(id % 7 = 0, '\\nrare one', ''), if(id % 100 = 3, NULL, '')) AS content")
    monkeypatch.setattr(G, "PIECE_FILES", 64)
    index = G.GrepIndex(spark, f"file://{tmp_path}").build(files)
    rows = index.store.read("postings", G._POSTINGS).where(F.col("gram") == G.number_of("com"))
    assert rows.count() == 8 and index._frequencies({"com", "rar", "zzz"}) == {"com": 495, "rar": 71, "zzz": 0}
    lines = lambda rows: sorted(map(tuple, rows.collect()))
    for most in (G.MOST_FILES, 10):
        monkeypatch.setattr(G, "MOST_FILES", most)
        for p in ("rare", "common", "text 1?3", "zebra"):
            assert lines(index.matching_lines(files, p)) == lines(retrieval.matching_lines(files, p)), (most, p)
    gone = files.where("path IN ('f0', 'f7')")
    index.remove(gone)
    assert lines(index.matching_lines(files, "rare")) == lines(retrieval.matching_lines(files.join(gone, "path", "left_anti"), "rare"))
    assert index.add(files) == 2 and lines(index.matching_lines(files, "rare")) == lines(retrieval.matching_lines(files, "rare"))
