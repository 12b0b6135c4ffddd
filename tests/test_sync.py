"""Cloning, scanning, indexing and generating: what is there is skipped, the rest is done once."""

import io
import json
import subprocess
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import providers as P
from lodestone.functions import registry
from lodestone.functions import text as X
from lodestone.functions.pdf import pdf_pages
from lodestone.operators import mutations as M
from lodestone.operators import options as O
from lodestone.plans import endpoints as N
from lodestone.plans import enrich, ingest, keyword, sync
from lodestone.plans.keyword import KeywordIndex
from lodestone.schemas import TABLES
from lodestone.sources import git


def table(spark, name, *rows):
    names = TABLES[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[name])


def catalog(spark, texts, edges, locations=(), files=()):
    return N.Catalog({
        "enrichments_v2": table(spark, "enrichments_v2", *[dict(id=i, type=t, subtype=s, content=c) for i, t, s, c in texts]),
        "enrichment_associations": table(spark, "enrichment_associations", *[dict(id=n, enrichment_id=i, entity_type=t, entity_id=e) for n, (i, t, e) in enumerate(edges)]),
        "source_locations": table(spark, "source_locations", *[dict(enrichment_id=i, page=p) for i, p in locations]),
        "git_commit_files": table(spark, "git_commit_files", *[dict(id=i, commit_sha=s, path=p) for i, s, p in files]),
        "git_commits": table(spark, "git_commits", dict(commit_sha="c1", repo_id=1)),
    })


# --- models


class Flaky:
    """Fails as often as told, then answers."""

    def __init__(self, failures):
        self.failures = list(failures)

    def __call__(self, *args):
        if self.failures:
            raise self.failures.pop(0)
        return args


def test_retry():
    waits = []
    retry = P.Retry(attempts=4, first=1, factor=3, longest=5, sleep=waits.append)
    assert retry(lambda f=Flaky([P.ProviderError("busy", 429), ConnectionError("gone"), P.ProviderError("down", 503)]): f("ok")) == ("ok",) and waits == [1, 3, 5]
    for error in (P.ProviderError("no", 400), P.Unsupported("no")):
        waits.clear()
        with pytest.raises(type(error)):
            retry(lambda f=Flaky([error]): f())
        assert waits == []
    with pytest.raises(P.ProviderError):
        retry(lambda f=Flaky([TimeoutError()] * 9): f())
    assert len(waits) == 3


def test_checked_embedder():
    asked = []

    def model(texts):
        asked.append(texts)
        return np.ones((len(texts) - (len(asked) == 1), 2))

    embed = P.Checked(model, P.Retry(3, sleep=lambda s: None), query_instruction="Q: ", document_instruction="D: ")
    assert embed(["a", "b"]).shape == (2, 2) and asked == [["D: a", "D: b"]] * 2  # one vector was missing at first
    embed([P.Item("x", is_query=True)])
    assert asked[-1] == ["Q: x"] and embed([]).shape == (0, 0)
    with pytest.raises(P.Unsupported):
        embed([P.Item(image=b"1")])


def test_dual_encoder():
    both = P.DualEncoder(lambda t: [[len(x), 0.0] for x in t], lambda b: [[0.0, 2.0] for _ in b])
    assert both([P.Item("abc"), P.Item(image=b"1"), P.Item("abc", b"1")]).tolist() == [[1, 0], [0, 1], [0, 1]]
    with pytest.raises(P.Unsupported):
        both([P.Item()])


def test_remote_models():
    seen = []

    def post(url, headers, body):
        seen.append((url, body))
        if url.endswith("/embeddings"):
            return {"model": "m", "data": [{"index": k, "embedding": [k, 1]} for k in reversed(range(len(body["input"])))]}
        return {"content": [{"text": "hi"}]} if url.endswith("/messages") else {"choices": [{"message": {"content": "ho"}}]}

    assert P.RemoteEmbedder("http://h/", "m", post=post)(["a", "b"]).tolist() == [[0, 1], [1, 1]]
    assert P.RemoteChat("http://h", "m", post=post)("s", "t") == "ho" and P.RemoteChat("http://h", "m", form="messages", post=post)("s", "t") == "hi"
    assert [u for u, _ in seen] == ["http://h/embeddings", "http://h/chat/completions", "http://h/messages"]
    with pytest.raises(P.ProviderError, match="empty answer"):
        P.RemoteEmbedder("http://h", "m", retry=P.Retry(3, sleep=lambda s: None), post=lambda *a: {})(["a"])
    with pytest.raises(P.ProviderError, match="1 vectors for 2"):
        P.RemoteEmbedder("http://h", "m", retry=P.Retry(2, sleep=lambda s: None), post=lambda *a: {"model": "m", "data": [{"embedding": [1]}]})(["a", "b"])


def test_once_per_worker():
    made = []
    model = P.OncePerWorker("test", lambda: made.append(1) or (lambda x: x + 1))
    assert model(1) == 2 and model(2) == 3 and made == [1]


def test_parallel_models(spark):
    """Batches of a task run at once; answers keep their places, failed ones stay marked."""
    rows = spark.createDataFrame([(str(k), f"text {k}") for k in range(20)] + [("bad", "bad")], "snippet_id string, text string").coalesce(1)
    base = ingest.hash_embedder(4)

    def model(items):
        if "bad" in items:
            raise P.Unsupported("no")
        return base(items)

    got = {r["snippet_id"]: r for r in ingest.embed(rows, model, most_rows=1, parallel=4).collect()}
    assert got["bad"]["embedding"] is None and "no" in got["bad"]["error"]
    assert all(got[str(k)]["embedding"] == pytest.approx(base([f"text {k}"])[0].tolist()) for k in range(20))
    answers = ingest.generate(rows.select(F.col("snippet_id").alias("id"), F.lit("s").alias("system"), "text"), lambda s, t: t.upper() if t != "bad" else 1 / 0, parallel=4).collect()
    assert {r["id"]: r["answer"] for r in answers} == {str(k): f"TEXT {k}" for k in range(20)} | {"bad": None}


# --- clones and commits


@pytest.fixture(scope="module")
def origin(tmp_path_factory):
    path = tmp_path_factory.mktemp("origin")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (path / "a.py").write_text("def a():\n    return 1\n" * 9)
    run("add", ".")
    run("commit", "-qm", "one")
    return path, run


def test_clone_and_sync(spark, origin, tmp_path):
    path, run = origin
    repos = table(spark, "git_repos", dict(id=1, sanitized_remote_uri=str(path)), dict(id=2, sanitized_remote_uri=str(path), cloned_path="/there"), dict(id=3, sanitized_remote_uri="/nowhere/at/all"))
    got = {r["repo_id"]: r for r in sync.clone(repos.drop("remote_uri"), str(tmp_path)).collect()}
    assert set(got) == {1, 3} and got[1]["error"] is None and git.is_clone(got[1]["cloned_path"]) and got[3]["cloned_path"] is None and got[3]["error"]
    cloned = got[1]["cloned_path"]
    run("commit", "-qm", "two", "--allow-empty")
    assert git.pull(cloned) and git.git(cloned, "log", "-1", "--format=%s").decode().strip() == "two"
    git.checkout(cloned, "HEAD~1")
    assert not git.pull(cloned)
    # a folder that is no clone is replaced
    (tmp_path / "stale" / ".git").mkdir(parents=True)
    assert git.is_clone(git.ensure_clone(str(path), str(tmp_path / "stale"), "main"))
    git.remove_clone(cloned)
    assert not git.is_clone(cloned)
    branched = git.branches(spark.createDataFrame([(1, str(path))], "repo_id long, path string"))
    head = git.git(str(path), "rev-parse", "HEAD").decode().strip()
    assert git.latest_shas(branched).first()["commit_sha"] == head and git.branch_heads(branched).first()["heads"] == {"main": head}


def test_sync_tasks(spark):
    repos = table(spark, "git_repos", dict(id=1, tracking_type="branch", tracking_name="dev"), dict(id=2, tracking_type="commit", tracking_name="abc"), dict(id=3), dict(id=4, tracking_type="tag", tracking_name="v1"), dict(id=5))
    branches = table(spark, "git_branches", *[dict(repo_id=r, name=n, head_commit_sha=s, is_default=d) for r, n, s, d in ((1, "main", "m1", True), (1, "dev", "d1", False), (3, "x", "x3", False), (3, "a", "a3", False), (4, "main", "m4", True))])
    assert {r["repo_id"]: r["commit_sha"] for r in sync.chosen_commits(repos, branches).collect()} == {1: "d1", 2: "abc", 3: "a3", 4: "m4"}
    tasks = {(json.loads(r["payload"])["repository_id"], r["type"]): r for r in sync.sync(repos, branches, ["commit.scan", "commit.chunks", "commit.bm25"]).collect()}
    assert len(tasks) == 12 and [tasks[1, t]["priority"] for t in ("commit.scan", "commit.chunks", "commit.bm25")] == [2030, 2020, 2010]
    assert tasks[1, "commit.scan"]["dedup_key"] == "commit.scan:d1:1"
    assert [tuple(r) for r in sync.default_tracking(branches).orderBy("repo_id").collect()] == [(1, "branch", "main"), (4, "branch", "main")]


def test_scan_and_chunk(spark):
    commits = table(spark, "git_commits", dict(commit_sha="c1", repo_id=1))
    targets = spark.createDataFrame([("c1",), ("c2",)], "commit_sha string")
    details = table(spark, "git_commits", dict(commit_sha="c1"), dict(commit_sha="c2", message="new"))
    files = spark.createDataFrame([("c1", "a.py"), ("c2", "a.py"), ("c2", "b.py")], "commit_sha string, path string")
    got = sync.scan(targets, commits, details, files)
    assert [r["message"] for r in got["git_commits"].collect()] == ["new"] and got["git_commit_files"].select("id").distinct().count() == 2
    assert sync.scan(targets.where("commit_sha = 'c1'"), commits, details, files)["git_commit_files"].count() == 0
    rows = spark.createDataFrame([(1, 1, "c1", "a.py", "x = 1\n" * 30), (2, 1, "c2", "a.py", "y = 2\n" * 30), (3, 1, "c2", "b.bin", "z" * 99), (4, 1, "c2", "c.py", None)], "id long, repo_id long, commit_sha string, path string, content string")
    chunks = sync.chunk_commits(rows, spark.createDataFrame([("c1",)], "commit_sha string"))
    assert {r["content"][0] for r in chunks["enrichments_v2"].collect()} == {"y"}


# --- indexes


def test_index_keywords(spark, tmp_path):
    """A commit without chunks, one that is indexed and one with some new chunks."""
    c = catalog(spark, [(1, "development", "chunk", "red fox"), (2, "development", "chunk", "blue fox"), (3, "development", "chunk", ""), (4, "development", "summary", "no")], [(i, "git_commits", s) for i, s in ((1, "c1"), (2, "c2"), (1, "c2"), (3, "c3"), (4, "c4"))])
    index = KeywordIndex(spark, f"file://{tmp_path}", "porter", 3)
    assert sync.index_keywords(c, index, "c4") == (0, "no chunks to index") and sync.index_keywords(c, index, "c3") == (0, "no chunk has a text")
    assert sync.index_keywords(c, index, "c1") == (1, None) and sync.index_keywords(c, index, "c1") == (0, "all chunks are indexed")
    assert sync.index_keywords(c, index, "c2") == (1, None) and index.count() == 2 and index.has("2") and not index.has("3")
    assert [r["id"] for r in index.find("fox", 9).collect()] == ["1", "2"]


def test_index_embeddings(spark, tmp_path):
    c = catalog(spark, [(1, "development", "chunk", "red"), (2, "development", "chunk", "blue"), (5, "development", "snippet_summary", "about red")], [(1, "git_commits", "c1"), (2, "git_commits", "c1"), (5, "enrichments_v2", "1")])
    store = M.TableStore(spark, f"file://{tmp_path}")
    model = ingest.hash_embedder(4)
    assert sync.index_embeddings(c, store, "code", "c1", model) == (2, None) and sync.index_embeddings(c, store, "code", "c1", model) == (0, "all are embedded")
    assert sync.index_embeddings(c, store, "code", "none", model) == (0, "nothing to embed")
    assert sync.index_summaries(c, store, "c1", model) == 1 and [r["snippet_id"] for r in store.read("vectors_text").collect()] == ["1"]
    # vectors of another length replace the table
    rows = spark.createDataFrame([("1", "red"), ("9", "new")], "snippet_id string, text string")
    assert ingest.index_vectors(store, "code", rows, ingest.hash_embedder(8)) == 2
    assert {(r["snippet_id"], len(r["embedding"])) for r in store.read("vectors_code").collect()} == {("1", 8), ("9", 8)}


def office(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, n.encode())
    return out.getvalue()


def test_page_images(spark, tmp_path):
    """New pages with a location, a file and a rasterizer are embedded, also in a last batch that is not full."""
    files = [(10, "c1", "s.pptx"), (11, "c1", "p.png"), (12, "c1", "x.pdf"), (13, "c1", "../up.png")]
    pages = [(1, 10, 1), (2, 10, 2), (3, 11, 1), (4, 12, 1), (5, 13, 1), (6, 10, 9), (7, 99, 1)]
    c = catalog(spark, [(i, "development", "page_image", "") for i, _, _ in pages] + [(8, "development", "page_image", "")], [(i, "git_commits", "c1") for i in range(1, 9)] + [(i, "git_commit_files", str(f)) for i, f, _ in pages] + [(8, "git_commit_files", "11")], [(i, p) for i, _, p in pages], files)
    contents = spark.createDataFrame([("c1", "s.pptx", office(["ppt/media/b.png", "ppt/media/a.jpg", "ppt/slides/x.xml"])), ("c1", "p.png", b"pic"), ("c1", "x.pdf", b"%PDF"), ("c1", "../up.png", b"no")], "commit_sha string, path string, content binary")
    seen = spark.sparkContext.accumulator(0)

    def model(images):
        seen.add(1)
        return [[float(len(i)), 1.0] for i in images]

    store = M.TableStore(spark, f"file://{tmp_path}")
    assert sync.index_page_images(c, store, "c1", contents, model, batch=2) == 3
    got = {r["snippet_id"]: r["embedding"][0] for r in store.read("vectors_vision").collect()}
    assert got == {"1": float(len("ppt/media/a.jpg")), "2": float(len("ppt/media/b.png")), "3": 3.0}
    assert sync.index_page_images(c, store, "c1", contents, model) == 0
    known = spark.createDataFrame([("s.pptx", "pptx", contents.first()["content"]), ("p.png", "png", b"pic"), ("b.docx", "docx", b"broken"), ("t.txt", "txt", b"x")], "path string, extension string, content binary")
    found = {(r["path"], r["page"]): (r["image"], r["error"] is None) for r in registry.picture_pages(known).collect()}
    assert set(found) == {("s.pptx", 1), ("s.pptx", 2), ("p.png", 1), ("b.docx", 0)} and found["p.png", 1] == (bytearray(b"pic"), True) and not found["b.docx", 0][1]
    assert N.read_raster(registry.picture_pages(known), 2).first()["image"] == "cHB0L21lZGlhL2IucG5n"
    made = sync.page_images(spark.createDataFrame([(1, "c1", "s.pptx", 2), (1, "c2", "s.pptx", 1), (1, "c2", "t.txt", 4)], "repo_id long, commit_sha string, path string, page_count int"), spark.createDataFrame([("c1",)], "commit_sha string"))
    assert [(r["commit_sha"], r["page"], r["content"]) for r in made.collect()] == [("c2", 1, "")]


def test_pages(spark):
    pages = spark.createDataFrame([("a", 1, "x\ny"), ("a", 2, "z"), ("b", 1, "")], "path string, page int, text string")
    assert {r["path"]: r["page_count"] for r in N.read_page(pages).collect()} == {"a": 2, "b": 1}
    assert [r["content"] for r in N.read_page(pages.where("path = 'a'"), 1, "L2", True).collect()] == ["2\ty"]
    with pytest.raises(ValueError):
        N.read_page(pages, 0)


# --- generated documents


def test_documents(spark):
    c = catalog(spark, [(1, "architecture", "physical", "old")], [(1, "git_commits", "c1")])
    contexts = spark.createDataFrame([("c1", "x"), ("c2", "services"), ("c3", ""), ("c4", "fail")], "commit_sha string, context string")
    rows, failed = enrich.write_documents(c, contexts, "architecture", lambda s, t: 1 / 0 if t == "fail" else f"<think>hm</think>{s}: {t}", "Tell")
    assert [(r["type"], r["subtype"], r["content"]) for r in rows["enrichments_v2"].collect()] == [("architecture", "physical", "Tell: services")]
    assert [r["entity_id"] for r in rows["enrichment_associations"].collect()] == ["c2"] and [r["commit_sha"] for r in failed.collect()] == ["c4"]
    files = spark.createDataFrame([("c", "db/a.sql", "a" * 30), ("c", "src/schema.rb", "b" * 30), ("c", "x.py", "no"), ("c", "z.proto", "late"), ("d", "n.py", "no")], "commit_sha string, path string, content string")
    got = {r["commit_sha"]: r["context"] for r in enrich.schema_contexts(files, per_file=10, most=40).collect()}
    assert got == {"c": "--- db/a.sql\n" + "a" * 10 + "\n--- src/schema.rb\n" + "b" * 10}


def test_wikis(spark):
    """Outline, pages, first page; a page that fails is left out with what is below it."""
    outline = {"pages": [{"slug": "a", "title": "A", "sources": ["a.py", "x_enrichment"], "children": [{"slug": "b", "title": "B", "sources": []}]}, {"slug": "bad", "title": "Bad", "children": [{"slug": "c", "title": "C"}]}]}

    def model(system, text):
        if system == enrich.PLAN:
            return "no plan" if text == "odd" else f"Here it is: ```{json.dumps(outline)}``` done"
        if system == enrich.INDEX:
            return "```md\nwelcome\n```"
        title = text.split("\n")[0]
        if title == "Bad":
            raise RuntimeError("no")
        return f"```md\n{title}|{'def a' in text}|{'digest' in text}|{'readme' in text}\n```"

    c = catalog(spark, [(1, "usage", "wiki", "old")], [(1, "git_commits", "c0")])
    contexts = spark.createDataFrame([("c0", "x"), ("c1", "readme"), ("c2", "odd")], "commit_sha string, context string")
    files = spark.createDataFrame([("c1", "a.py", "def a")], "commit_sha string, path string, content string")
    rows, failed = enrich.wikis(c, contexts, files, spark.createDataFrame([("c1", "digest")], "commit_sha string, digest string"), model)
    tree = json.loads(rows["enrichments_v2"].first()["content"])["pages"]
    assert rows["enrichments_v2"].count() == 1 and [r["commit_sha"] for r in failed.collect()] == ["c2"]
    assert [(p["slug"], p["content"]) for p in tree] == [("index", "welcome"), ("a", "A|True|True|False")]
    assert [(p["slug"], p["content"]) for p in tree[1]["children"]] == [("b", "B|False|False|True")]


# --- tables and functions


def test_migrations(spark, tmp_path):
    store = M.open_store(spark, f"file://{tmp_path}")
    store.transaction({"t": spark.createDataFrame([(1, "a")], "id int, old string"), "u": spark.range(2)}, additions={"w": spark.range(3)})
    steps = [("rename", lambda s: s.rename_column("t", "old", "new"))]
    assert M.migrate(store, steps) == ["rename"] and M.migrate(store, steps) == [] and store.read("t").columns == ["id", "new"]

    def fails(s):
        s.transaction({"u": spark.range(9), "t": spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))})

    with pytest.raises(Exception):
        M.migrate(store, [*steps, ("fails", fails)])
    assert store.read("u").count() == 2 and store.read("t").first()["new"] == "a"
    store.append("w", spark.range(4))
    assert store.read("w").count() == 7 and store.read("w", "id long").agg(F.sum("id")).first()[0] == 9
    store.vacuum(["t", "u"])
    assert store.read("t").count() == 1
    assert M.open_store(spark, "postgresql://h/db").address == "jdbc:postgresql://h/db" and M.open_store(spark, "sqlite:///f.db").address == "jdbc:sqlite:/f.db"


def test_sql_functions(spark):
    registry.register_sql(spark)
    row = spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c, cosine(array(1D), array(1D, 1D)) AS none, bag_terms('The running nations') AS t, csv_summary('a,b\\n1,x\\n') AS s, 'src/a.py' RLIKE glob_regex('**/*.py') AS g").first()
    assert row["c"] == pytest.approx(0.5**0.5) and row["none"] == 0 and row["t"] == ["run", "nation"] and row["s"].startswith("Headers: a b\nValues: x") and row["g"]


def test_pick_lines_by(spark):
    text = "\n".join("abcdefgh")
    specs = ["", None, "L2", "L2-L3,L6", "L2-3", "L7-L99", "L99", "L3-L2", "L0", "2", "L1,L2,L4"]
    got = [r[0] for r in spark.createDataFrame([(text, s) for s in specs], "t string, s string").select(X.pick_lines_by(F.col("t"), F.col("s"))).collect()]
    want = []
    for s in specs:
        try:
            ranges = X.parse_lines(s or "")
        except ValueError:
            want.append(None)
            continue
        want.append(spark.createDataFrame([(text,)], "t string").select(X.pick_lines(F.col("t"), ranges)).first()[0])
    assert got == want
    parts = X.parse_file_uri(F.lit("file://7/main/src/a b.py?lines=L2-L3&line_numbers=true&page=4"))
    assert tuple(spark.range(1).select(*parts.values()).first()) == (7, "main", "src/a b.py", "L2-L3", 4, True)


def test_settings(spark):
    repos = table(spark, "git_repos", dict(id=1, chunk_size=900), dict(id=2, pipeline_id=3))
    c = N.Catalog({"git_repos": repos})
    assert tuple(N.settings(c, "chunking", 1).first()) == (1, 900, 200, 50) and N.settings(c, "pipeline", 2).first()["pipeline_id"] == 3
    changed = N.change_settings(c, "chunking", 1, chunk_size=100, chunk_overlap=20, min_chunk_size=10).where("id = 1").first()
    assert (changed["chunk_size"], changed["chunk_overlap"], changed["min_chunk_size"]) == (100, 20, 10)
    for kind, values in (("chunking", {"chunk_size": 100}), ("tracking", {"color": 1})):
        with pytest.raises(ValueError):
            N.change_settings(c, kind, 1, **values)
    with pytest.raises(PermissionError):
        N.settings(c.scoped([2]), "chunking", 1)


def pdf(contents, packed):
    """A small file: a page for each content, fonts of one and two bytes, objects plain or in an object stream."""
    table = b"1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <0062> endbfrange"
    pages = [6 + 2 * k for k in range(len(contents))]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % b" ".join(b"%d 0 R" % p for p in pages), 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    streams = {5: table}
    for p, c in zip(pages, contents):
        objects[p], streams[p + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (p + 1), c
    out = b"%PDF-1.5\n"
    if packed:
        bodies, at, numbers = [], 0, []
        for n, o in objects.items():
            numbers.append(b"%d %d" % (n, at))
            bodies.append(o + b" ")
            at += len(o) + 1
        head = b" ".join(numbers) + b" "
        whole = zlib.compress(head + b"".join(bodies))
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode >> stream\n" % (len(objects), len(head)) + whole + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items())
    for n, c in streams.items():
        out += b"%d 0 obj << /Filter /FlateDecode >> stream\n" % n + zlib.compress(c) + b"\nendstream endobj\n"
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, packed):
    data = pdf([b"BT /F1 12 Tf (Hello \\(a\\) ) Tj [(wor) -20 (ld) -300 (\\344\\351)] TJ 0 -14 Td (next) Tj ET", b"BT /F2 9 Tf <000300100012> Tj T* [<0011> -400 <0003>] TJ ET", b""], packed)
    assert pdf_pages(data) == ["Hello (a) world äé\nnext", "Abd\nc A", ""]
    files = spark.createDataFrame([("a.pdf", "pdf", data), ("b.pdf", "pdf", b"no"), ("c.pdf", "pdf", b"%PDF /Encrypt 3 0 R")], "path string, extension string, content binary")
    got = {(r["path"], r["page"]): (r["text"], r["error"]) for r in registry.document_pages(files).collect()}
    assert got["a.pdf", 2] == ("Abd\nc A", None) and got["b.pdf", 0][1] and got["c.pdf", 0][1] and len(got) == 5


def test_architecture(spark):
    text = "services:\n  web:\n    image: nginx\n    ports: ['8080:80']\n    depends_on: [db]\n    environment:\n      URL: redis://cache:6379/0\n  db:\n    build: .\n  cache:\n"
    pytest.importorskip("yaml")
    files = spark.createDataFrame([("c", "docker-compose.yml", text), ("c", "a/compose.yaml", ": no ["), ("d", "x.yml", text)], "commit_sha string, path string, content string")
    got = {r["commit_sha"]: r["context"] for r in enrich.architecture_contexts(files).collect()}
    assert got == {"c": "docker-compose.yml\nServices\n- cache\n- db: built here\n- web: nginx, ports 80 (HTTP)\nConnections\n- web -> db (depends_on)\n- web -> cache (url)"}
    contexts = spark.createDataFrame([(1, "x"), (2, "y")], "repo_id long, context string")
    texts = spark.createDataFrame([(1, "b", "second"), (1, "a", "f" * 30), (2, "a", "")], "repo_id long, name string, content string")
    assert {r["repo_id"]: r["context"] for r in enrich.with_digests(contexts, texts, most=5).collect()} == {1: "x\n\na\nfffff\n\nb\nsecon", 2: "y"}


def test_options_of_searches(spark, tmp_path):
    docs = spark.createDataFrame([(str(k), f"fox {'dog ' * (k % 3)}") for k in range(9)], "id string, text string")
    index = KeywordIndex(spark, f"file://{tmp_path}", "words", 2).build(docs)
    few = docs.where("id IN ('1', '2')").select("id")
    ids = lambda df: [r[0] for r in df.collect()]
    assert ids(keyword.find(index, O.build(O.with_query("fox"), O.with_limit(2)))) == ["0", "3"] and ids(keyword.find(index, O.build(O.with_query("fox"), O.with_pagination(2, 1)))) == ["3", "6"]
    assert ids(keyword.find(index, O.build(O.with_query("fox"), O.with_allowed(few)))) == ["1", "2"] and ids(keyword.find(index, O.build(O.with_query("fox"), O.with_allowed(few.limit(0))))) == []
    assert sorted(ids(keyword.find(index, O.build(O.with_snippet_id_in(["3", "99"]))))) == ["3"]
    vectors = spark.createDataFrame([(k, [1.0, float(k)], "a" if k % 2 else "b") for k in range(6)], "id long, embedding array<double>, task string")
    assert ids(keyword.find_vectors(vectors, O.build(O.with_embedding([1.0, 0.0]), O.with_condition("task", "a"), O.with_limit(2)))) == [1, 3]
    assert sorted(ids(keyword.find_vectors(vectors, O.build(O.with_condition("task", "b"))))) == [0, 2, 4]


def test_remove_repository(spark, tmp_path):
    folder = tmp_path / "clone"
    folder.mkdir()
    names = ("git_repos", "git_commits", "git_branches", "git_tags", "git_commit_files", "enrichments_v2", "enrichment_associations", "source_locations", "tasks")
    c = N.Catalog({n: table(spark, n, dict(id=1, cloned_path=str(folder)), dict(id=2)) if n == "git_repos" else table(spark, n) for n in names})
    assert [r["id"] for r in sync.remove_repository(c, 1)["git_repos"].collect()] == [2] and not folder.exists()
