"""Text, path, URI and JSON functions as Columns; all stay inside Spark's generated code."""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language and media type by file extension; other extensions name themselves.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "rb": "ruby", "rs": "rust", "java": "java", "c": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "c", "cs": "csharp", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala",
    "sh": "shell", "bash": "shell", "sql": "sql", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "vue": "vue", "svelte": "svelte",
}
MEDIA_TYPES = {
    "go": "text/x-go", "py": "text/x-python", "js": "text/javascript", "ts": "text/typescript", "tsx": "text/typescript", "jsx": "text/javascript", "java": "text/x-java-source",
    "c": "text/x-c", "cpp": "text/x-c++", "cc": "text/x-c++", "cxx": "text/x-c++", "h": "text/x-c", "hpp": "text/x-c", "cs": "text/x-csharp", "rs": "text/x-rust", "rb": "text/x-ruby",
    "php": "text/x-php", "swift": "text/x-swift", "kt": "text/x-kotlin", "kts": "text/x-kotlin", "scala": "text/x-scala", "sh": "text/x-shellscript", "bash": "text/x-shellscript",
    "sql": "text/x-sql", "md": "text/markdown", "markdown": "text/markdown", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "xml": "application/xml",
    "html": "text/html", "htm": "text/html", "css": "text/css", "scss": "text/scss", "sass": "text/scss",
}
#: Extensions worth indexing.
INDEXABLE = (
    "go py pyi pyx js mjs cjs jsx ts mts cts tsx rb erb rs java kt kts scala groovy c h cpp cc cxx hpp hxx m mm cs fs fsx php swift sh bash zsh fish sql r lua pl pm ex exs erl hrl hs clj cljs cljc dart zig nim jl ml mli v d html htm css scss sass less vue svelte md mdx rst adoc tex proto graphql gql thrift csv"
).split()
#: What marks a line of a public interface, by language.
API_INDICATORS = {
    "python": ("def ", "class ", "async def "),
    "go": ("func ", "type ", "var ", "const "),
    "javascript": ("export ", "function ", "class ", "const ", "async function "),
    "typescript": ("export ", "function ", "class ", "const ", "async function "),
    "java": ("public ", "class ", "interface "),
    "rust": ("pub fn ", "pub struct ", "pub enum ", "pub trait "),
}


def glob_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` stay inside one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])))
            i += 1
    return f"^{''.join(out)}$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def _rlike(rule: str, part: Column) -> Column:
    return part.rlike(rule)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Inside .git, or a pattern fits the whole path or any of its parts."""
    rules = [glob_regex(p.strip().rstrip("/")) for p in patterns if p.strip() and not p.startswith("#")]
    tests = [path.rlike(r) | F.exists(F.split(path, "/"), partial(_rlike, r)) for r in rules]
    return reduce(lambda a, b: a | b, tests, path.startswith(".git/") | (path == ".git"))


def parse_lines(spec: str) -> list[tuple[int, int]]:
    """``L17-L26,L45`` as line ranges; lines start at 1, a range does not run backwards, nothing means all."""
    out = []
    if not spec:
        return out
    for part in spec.split(","):
        if not (m := re.fullmatch(r"\s*L(\d+)(?:-L?(\d+))?\s*", part)):
            raise ValueError(f"no line range: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if first < 1 or last < first:
            raise ValueError(f"no line range: {part!r}")
        out.append((first, last))
    return out


def number_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x))


def pick_lines(text: Column, ranges: list[tuple[int, int]], numbered: bool = False) -> Column:
    """The lines of the ranges, ``...`` where lines are left out between two; ends are clamped."""
    lines = F.split(text, "\n", -1)
    shown = number_lines(lines) if numbered else lines
    parts, end = [], None
    for first, last in ranges:
        if end is not None and first > end + 1:
            parts.append(F.when(F.size(lines) >= first, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")))
        parts.append(F.when(F.size(lines) >= first, F.slice(shown, first, last - first + 1)).otherwise(F.array().cast("array<string>")))
        end = last
    return F.array_join(F.concat(*parts), "\n") if parts else F.array_join(shown, "\n")


def pick_lines_by(text: Column, spec: Column, numbered: Column | bool = False) -> Column:
    """As :func:`pick_lines`, with a spec of line ranges in each row; null for a spec that is none."""
    flag = numbered if isinstance(numbered, Column) else F.lit(numbered)
    bare = F.coalesce(spec, F.lit(""))

    def range_of(part: Column) -> Column:
        first = F.regexp_extract(part, r"^\s*L(\d+)", 1).cast("int")
        return F.struct(first.alias("first"), F.coalesce(F.nullif(F.regexp_extract(part, r"-L?(\d+)\s*$", 1), F.lit("")).cast("int"), first).alias("last"))

    def shown(lines: Column) -> Column:
        rows = F.when(flag, number_lines(lines)).otherwise(lines)

        def add(done: Column, r: Column) -> Column:
            gap = F.when((done["end"] > 0) & (r["first"] > done["end"] + 1), F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
            more = F.when(F.size(lines) >= r["first"], F.concat(gap, F.slice(rows, r["first"], r["last"] - r["first"] + 1))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(done["out"], more).alias("out"), r["last"].alias("end"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("end"))
        picked = F.aggregate(F.transform(F.split(bare, ","), range_of), start, add)["out"]
        return F.array_join(F.when(bare == "", rows).otherwise(picked), "\n")

    ranges = F.transform(F.split(bare, ","), range_of)
    good = (bare == "") | (bare.rlike(r"^\s*L\d+(-L?\d+)?\s*(,\s*L\d+(-L?\d+)?\s*)*$") & F.forall(ranges, lambda r: (r["first"] >= 1) & (r["last"] >= r["first"])))
    return F.when(good & text.isNotNull(), F.transform(F.array(F.split(text, "\n", -1)), shown)[0])


def parse_file_uri(uri: Column) -> dict[str, Column]:
    """repo, ref, path, lines, page and line_numbers of a ``file://repo/ref/path?…`` address; null parts where it is none."""
    head = r"^file://(\d+)/([^/?]+)/([^?]*)"
    part = lambda n: F.nullif(F.regexp_extract(uri, head, n), F.lit(""))
    value = lambda name: F.nullif(F.regexp_extract(uri, rf"[?&]{name}=([^&]*)", 1), F.lit(""))
    return {"repo": part(1).cast("long"), "ref": part(2), "path": part(3), "lines": value("lines"), "page": value("page").try_cast("int"), "line_numbers": F.coalesce(value("line_numbers") == "true", F.lit(False))}


def is_repository_operation(operation: Column) -> Column:
    return operation.startswith("repository.")


def is_commit_operation(operation: Column) -> Column:
    return operation.startswith("commit.")


def lines_kept(text: Column) -> Column:
    """Lines with their line feed."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+$"), 0)


def blank_tokens(text: Column) -> Column:
    """Runs that end in blanks or tabs."""
    return F.filter(F.regexp_extract_all(text, F.lit("[^ \t]*[ \t]*"), 0), lambda t: t != "")


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def _valid(data: Column) -> Column:
    """Bytes as text, with a replacement character for what is not UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def truncate_bytes(text: Column, limit: int, notice: str) -> Column:
    """At most ``limit`` bytes and a notice; a character that would be cut is left out."""
    data = F.encode(text, "UTF-8")
    # the first byte left out starts a character
    clean = F.coalesce(*[F.when(~F.hex(F.substring(data, limit + 1 - k, 1)).rlike("^[89AB]"), _valid(F.substring(data, 1, limit - k))) for k in range(min(4, limit + 1))], F.lit(""))
    return F.when(F.octet_length(text) > limit, F.concat(clean, F.lit(notice))).otherwise(text)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def _mapped(key: Column, values: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), other)


def language_of(path: Column) -> Column:
    return _mapped(extension(path), LANGUAGES, extension(path))


def media_type(ext: Column, default: str = "text/plain") -> Column:
    return _mapped(ext, MEDIA_TYPES, F.lit(default))


def is_indexable(path: Column) -> Column:
    return F.lower(extension(path)).isin(INDEXABLE)


def is_test_file(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0).rlike("test|spec")


def is_version_tag(name: Column) -> Column:
    return name.rlike("^(v[0-9]|[0-9])")


def relative_path(path: Column) -> Column:
    """The part of an absolute clone path below the repository."""
    return F.regexp_replace(path, "^.*/(clones|repos)/[^/]+/", "")


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and nowhere above its folder."""
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"), F.least(s["least"], s["now"] + F.when(p == "..", -1).otherwise(1)).alias("least")),
    )
    return (path != "") & ~path.startswith("/") & (depth["least"] >= 0) & (depth["now"] > 0)


def sanitize_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "//[^@/]*@", "//")


def uri_folder(uri: Column, length: int = 80) -> Column:
    """A folder name for a URI, cut and made distinct by a hash where it is long."""
    plain = F.regexp_replace(F.regexp_replace(sanitize_uri(uri), "^[a-z+]+://", ""), "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(F.substring(plain, 1, length - 9), F.lit("_"), F.substring(F.sha2(uri, 256), 1, 8)))


def author_name(author: Column) -> Column:
    found = F.regexp_extract(author, r"^(.*?) ?<[^<]*>[^>]*$", 1)
    return F.when(author.contains("<") & author.contains(">"), found).otherwise(author)


def author_email(author: Column) -> Column:
    return F.regexp_extract(author, r"<([^<]*)>[^>]*$", 1)


def format_author(name: Column, email: Column) -> Column:
    return F.when(F.coalesce(email, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))


def strip_dot(ext: Column) -> Column:
    return F.regexp_replace(ext, r"^\.", "")


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def dedup_key(operation: Column, payload: Column) -> Column:
    """The operation and the payload's values in the order of their keys."""
    entries = F.from_json(payload, "map<string,string>")
    return F.concat_ws(":", operation, F.transform(F.array_sort(F.map_keys(entries)), lambda k: F.element_at(entries, k)))


def status_id(kind: Column, number: Column, operation: Column) -> Column:
    return F.concat_ws("-", *[F.nullif(c.cast("string"), F.lit("")) for c in (kind, number, operation)])


def cache_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", method, url, body), 256)


def payload_number(payload: Column, key: str) -> Column:
    """A whole number of a JSON payload, null where it is none."""
    return F.get_json_object(payload, f"$.{key}").try_cast("long")


def merge_json(left: Column, right: Column) -> Column:
    """Top-level keys of both, the right one's values first."""
    a, b = (F.from_json(x, "map<string,string>") for x in (left, right))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z", "")


def strip_fence(text: Column) -> Column:
    """The text without its opening fence line and all from the last fence on."""
    bare = strip_space(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*\n", ""), r"(?s)^(.*)```.*\z", "$1")
    return F.when(bare.startswith("```") & bare.contains("\n"), strip_space(inner)).otherwise(bare)


def drop_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"</?think>", ""))


def decode_unless_binary(content: Column, probe: int = 8192) -> Column:
    """Text of a file, empty if a NUL is among its first bytes."""
    head = F.substring(content, 1, probe)
    return F.when(F.position(F.unhex(F.lit("00")), head) > 0, F.lit("")).otherwise(_valid(content))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset."""
    prefix = _valid(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")))
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def lines_at(text: Column, step: int) -> Column:
    """(offset, line) at 0 and every ``step`` bytes up to the text's end; each byte is read once."""

    def counted(data: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(data), F.lit(step))
        piece = lambda s: F.decode(F.substring(data, s + 1, F.lit(step)), "ISO-8859-1")
        breaks = F.transform(starts, lambda s: F.length(piece(s)) - F.length(F.replace(piece(s), F.lit("\n"), F.lit(""))))
        lines = F.aggregate(F.slice(breaks, 1, F.size(breaks) - 1), F.array(F.lit(1)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
        return F.zip_with(starts, lines, lambda s, n: F.struct(s.alias("offset"), n.alias("line")))

    return F.transform(F.array(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), counted)[0]


def page_of(boundaries: Column, offset: Column) -> Column:
    """The page of the last boundary (page, byte_offset) at or before the offset."""
    return F.element_at(F.filter(boundaries, lambda b: b["byte_offset"] <= offset), -1)["page"]


def indicator_count(text: Column, indicators: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(re.escape(i))) for i in indicators])


def api_lines(text: Column, indicators: tuple[str, ...], least: int = 3, first: int = 100) -> Column:
    """The interface lines among the first lines of a text that has enough of them, else empty."""
    test = lambda line: reduce(lambda a, b: a | b, [F.trim(line).contains(i) for i in indicators])
    lines = F.filter(F.slice(F.split(text, "\n", -1), 1, first), test)
    return F.when(indicator_count(text, indicators) >= least, F.array_join(lines, "\n")).otherwise(F.lit(""))


def api_block(text: Column, path: Column, language: str, least: int = 3) -> Column:
    found = api_lines(text, API_INDICATORS.get(language, ("\0",)), least)
    name = F.regexp_extract(path, "[^/]*$", 0)
    return F.when(found == "", F.lit("")).otherwise(F.concat(F.lit("### "), name, F.lit(f" ({language})\n\n```{language}\n"), found, F.lit("\n```")))


def file_uri(repo: Column, ref: Column, path: Column, start: Column | None = None, end: Column | None = None, page: Column | None = None) -> Column:
    base = F.concat(F.lit("file://"), repo.cast("string"), F.lit("/"), ref, F.lit("/"), path)
    if page is not None:
        return F.when(page > 0, F.concat(base, F.lit("?page="), page.cast("string"))).otherwise(base)
    if start is not None:
        return F.when(start > 0, F.concat(base, F.lit("?lines=L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(base)
    return base


def patch_files(patch: Column) -> Column:
    """Paths that a unified diff names, in order, once each."""
    return F.array_distinct(F.concat(F.regexp_extract_all(patch, F.lit("diff --git a/(.+?) b/"), 1), F.regexp_extract_all(patch, F.lit("(?m)^--- a/(.+)$"), 1)))


def is_patch(patch: Column) -> Column:
    return F.coalesce(patch.rlike("(?m)^(diff --git|---) "), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty or zero vectors and for unequal lengths."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (norms > 0), dot(x, y) / norms).otherwise(F.lit(0.0))


def distance_similarity(distance: Column) -> Column:
    return 1 - distance / 2


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")
