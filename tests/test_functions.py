import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import documents as D
from lodestone.functions import text as X
from lodestone.functions.chunker import ChunkConfig, batches, chunks
from lodestone.functions.stemming import stem, tokens

GLOBS = [
    ("*.go", "main.go", True), ("*.go", "src/main.go", False), ("**/*.go", "main.go", True), ("**/*.go", "src/main.go", True), ("**/*.go", "src/pkg/main.go", True),
    ("**/*.go", "README.md", False), ("*", "README.md", True), ("*", "src/main.go", False), ("src/*.go", "src/main.go", True), ("src/*.go", "src/pkg/main.go", False),
    ("src/**/*.go", "src/main.go", True), ("src/**/*.go", "src/pkg/main.go", True), ("src/**/*.go", "README.md", False), ("**", "any/path/here.txt", True), ("**", "file.txt", True),
]


@pytest.mark.parametrize("pattern,path,want", GLOBS)
def test_glob(pattern, path, want):
    assert bool(re.match(X.glob_regex(pattern), path)) == want


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_lines(spark):
    text = "a\nb\nc\nd\ne\nf\ng\nh"
    pick = lambda spec, n=False: one(spark, X.pick_lines(F.col("t"), X.parse_lines(spec), n), t=text)
    assert pick("L5") == "e"
    assert pick("L2-L4") == "b\nc\nd"
    assert pick("L1-L2,L4,L6-L7") == "a\nb\n...\nd\n...\nf\ng"
    assert pick("L5-L100") == "e\nf\ng\nh"
    assert pick("L1-L2,L3") == "a\nb\nc"
    assert pick("") == text
    assert pick("L2", True) == "2\tb"
    for bad in ("L0", "5", "L4-L2"):
        with pytest.raises(ValueError):
            X.parse_lines(bad)


def test_paths(spark):
    assert one(spark, X.extension(F.col("p")), p="a.b/c.tar.gz") == "gz"
    assert one(spark, X.language_of(F.col("p")), p="x/y.tsx") == "typescript"
    assert one(spark, X.media_type(F.lit("py"))) == "text/x-python"
    assert one(spark, X.relative_path(F.lit("/data/clones/repo/src/a.go"))) == "src/a.go"
    assert [one(spark, X.is_safe_path(F.lit(p))) for p in ("a/b", "/a", "", "../a", "a/../../b", "a/../b")] == [True, False, False, False, False, True]
    assert one(spark, X.sanitize_uri(F.lit("https://me:pw@host/x"))) == "https://host/x"
    assert len(one(spark, X.uri_folder(F.lit("https://host/" + "x" * 200)))) == 80
    assert one(spark, X.author_name(F.lit("A B <a@b>"))) == "A B" and one(spark, X.author_email(F.lit("A B <a@b>"))) == "a@b"
    assert one(spark, X.ignored(F.lit("src/node_modules/x.js"), ["node_modules", "# no", ""]))
    assert one(spark, X.is_test_file(F.lit("a/foo_test.go"))) and not one(spark, X.is_test_file(F.lit("test/foo.go")))
    assert one(spark, X.is_indexable(F.lit("A.PY")))


def test_json_and_ids(spark):
    assert one(spark, X.dedup_key(F.lit("op"), F.lit('{"b": 2, "a": 1}'))) == "op:1:2"
    assert one(spark, X.status_id(F.lit("repo"), F.lit(3), F.lit(""))) == "repo-3"
    assert one(spark, X.payload_number(F.lit('{"repository_id": "7"}'), "repository_id")) == 7
    assert one(spark, X.payload_number(F.lit('{"repository_id": "x"}'), "repository_id")) is None
    import json

    assert json.loads(one(spark, X.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')))) == {"a": "1", "b": "3"}
    assert one(spark, X.strip_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, X.drop_thinking(F.lit("<think>x</think>y<think>z"))) == "yz"
    assert one(spark, X.truncate_bytes(F.lit("äbc"), 3, "!")) == "äb!" and one(spark, X.truncate_bytes(F.lit("bä"), 2, "!")) == "b!"
    assert one(spark, X.patch_files(F.lit("diff --git a/x b/x\n--- a/x\n--- a/y\n"))) == ["x", "y"]
    assert one(spark, X.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3


def test_cosine(spark):
    def cos(a, b):
        return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b"))).first()[0]

    assert cos([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and cos([1.0, 0.0], [-1.0, 0.0]) == pytest.approx(-1) and cos([1.0, 0.0], [0.0, 1.0]) == 0
    assert cos([0.0, 0.0], [1.0, 1.0]) == 0 and cos([], []) == 0 and cos([1.0], [1.0, 2.0]) == 0
    assert cos([1.0, 1.0, 0.0], [1.0, 0.9, 0.1]) == pytest.approx(0.9959, abs=1e-3)


def test_chunks():
    c = lambda t, s, o, m=1: [(x.content, x.offset) for x in chunks(t, ChunkConfig(s, o, m))]
    assert [len(x) for x, _ in c("A" * 300, 100, 0)] == [100] * 3
    assert [x for x, _ in c("AAAAABBBBBCCCCC", 10, 5)] == ["AAAAABBBBB", "BBBBBCCCCC"]
    assert [o for _, o in c("Z" * 25, 10, 5)] == [0, 5, 10, 15]
    assert c("hello\nworld\nfoo\n", 10, 0) == [("hello\n", 0), ("world\nfoo\n", 6)]
    assert [o for _, o in c("aaa\nbbb\nccc\nddd\n", 8, 4)] == [0, 4, 8]
    assert c("aaaa bbbb cccc", 7, 0) == [("aaaa ", 0), ("bbbb ", 5), ("cccc", 10)]
    assert c("", 10, 0) == [] and c("short", 100, 0, 50) == []
    with pytest.raises(ValueError):
        ChunkConfig(10, 10)
    assert [(x.start_line, x.end_line) for x in chunks("a\nb\nc\nd\n", ChunkConfig(4, 0, 1))] == [(1, 2), (3, 4)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\né中", max_size=200), st.integers(2, 20), st.integers(0, 19))
def test_chunks_cover(text, size, overlap):
    overlap = min(overlap, size - 1)
    raw, seen = text.encode(), set()
    for x in chunks(text, ChunkConfig(size, overlap, 0)):
        assert raw[x.offset : x.offset + len(x.content.encode())] == x.content.encode()
        assert len(x.content) <= size + overlap
        seen |= set(range(x.offset, x.offset + len(x.content.encode())))
    assert seen == set(range(len(raw)))


def test_batches():
    sizes = lambda got: [got.count(b) for b in sorted(set(got))]
    assert sizes(batches([10] * 5, 25, 100)) == [2, 2, 1]
    assert sizes(batches([5, 50, 5], 20, 100)) == [1, 1, 1]
    assert sizes(batches([5] * 6, 100, 2)) == [2, 2, 2]


def test_stem():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "controlling": "control", "rate": "rate", "cease": "ceas"}
    assert {w: stem(w) for w in pairs} == pairs
    assert tokens("Foo_Bar-9 ÄÖ") == ["foo", "bar", "9", "ÄÖ"]


def test_csv_summary():
    got = D.csv_summary("name,age,city\nAnn,3,Rome\nBob,4,Rome\n")
    assert got.startswith("Headers: name age city\nValues: Ann Bob Rome") and got.endswith("Bob,4,Rome")
    assert D.csv_summary("a,b\n") == "Headers: a b" and D.csv_summary("") == ""
    assert D.csv_summary("x\n" + "\n".join(f"v{k}" for k in range(9))).count("\nv") == 5


def test_documents():
    import io
    import zipfile

    def office(files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)
        return buffer.getvalue()

    w = 'xmlns:w="w"'
    assert D.pages(office({"word/document.xml": f"<w:d {w}><w:p><w:t>Hello </w:t><w:t>you</w:t></w:p><w:p><w:t>there</w:t></w:p></w:d>"}), "docx") == ["Hello you\nthere"]
    assert D.pages(office({"ppt/slides/slide2.xml": '<a xmlns:a="a"><a:p><a:t>two</a:t></a:p></a>', "ppt/slides/slide1.xml": '<a xmlns:a="a"><a:p><a:t>one</a:t></a:p></a>', "ppt/notesSlides/notesSlide1.xml": '<a xmlns:a="a"><a:p><a:t>note</a:t></a:p></a>'}), "pptx") == ["one\nnote", "two"]
    assert D.pages(office({"xl/sharedStrings.xml": '<s xmlns="m"><si><t>hi</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="m"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>'}), "xlsx") == ["hi\t5"]
    assert D.media_names(office({"ppt/media/b.png": "", "ppt/media/a.JPG": "", "ppt/x.xml": ""})) == ["ppt/media/a.JPG", "ppt/media/b.png"]


def test_blocks():
    (b,) = D.markdown_blocks("# Use\nRun it:\n```py\nx = 1\ny = 2\n```\n")
    assert (b.code, b.language, b.line_start, b.line_end, b.context) == ("x = 1\ny = 2", "py", 4, 5, "Use Run it:")
    (r,) = D.rst_blocks("Try:\n\n.. code-block:: py\n\n   a = 1\n     b\n\nend")
    assert (r.code, r.language) == ("a = 1\n  b", "py")
    assert D.first_json('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}' and D.first_json("{") is None
    assert D.is_example("examples/a.py") and not D.is_example("a/examples.py") and D.is_documentation("x.md")


def test_wiki():
    text = '{"pages": [{"slug": "a", "title": "A", "children": [{"slug": "b", "title": "B"}, {"slug": "a", "title": "other"}]}]}'
    tree = D.parse_wiki(text)
    assert D.flatten(tree) == [("a", "a", "A", 0), ("b", "a/b", "B", 1), ("a", "a/a", "other", 1)]
    assert D.path_index(tree) == {"a": "a", "b": "a/b"} and D.find_page(tree, "a/b").title == "B"
    assert D.parse_wiki(D.wiki_json(tree)) == tree and D.rebuild(D.flatten(tree)) == tree
    assert D.rewrite_links("[x](b) [y](http://b) [z](/b) [w](no)", {"b": "a/b"}) == "[x](a/b) [y](http://b) [z](/b) [w](no)"


def test_services():
    services = {"web": {"depends_on": ["db"], "environment": {"U": "redis://cache:6379/0"}, "ports": ["8080:80"]}, "db": {}, "cache": {}}
    assert D.compose_edges(services) == [("web", "db", "depends_on"), ("web", "cache", "url")]
    assert D.service_ports(services["web"]) == [80] and D.protocol_of(5432) == "PostgreSQL"
