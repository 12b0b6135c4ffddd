"""Parsers of documents and of model answers, in plain Python for use in Arrow functions."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

#: Fixed value: larger documents are not read.
MOST_BYTES = 100 * 1024 * 1024


# --- tables and office files


def csv_summary(text: str, rows: int = 5) -> str:
    """Headers, the distinct values of columns that are not numeric, and the first rows."""
    table = list(csv.reader(io.StringIO(text), skipinitialspace=True))
    if not table:
        return ""
    header, body = table[0], table[1:]

    def number(v: str) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    values: list[str] = []
    for k in range(len(header)):
        column = [r[k].strip() for r in body if k < len(r) and r[k].strip()]
        if not all(map(number, column)):
            values += sorted(set(column))
    out = ["Headers: " + " ".join(header)]
    if values:
        out.append("Values: " + " ".join(values))
    if body:
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows(body[:rows])
        out.append("Top rows:\n" + buffer.getvalue())
    return "\n".join(out).strip()


def _texts(xml: bytes, leaf: str, block: str) -> str:
    """The text of ``leaf`` elements, one line for each ``block``."""
    local = lambda tag: tag.rsplit("}", 1)[-1]
    lines = []
    for b in ElementTree.fromstring(xml).iter():
        if local(b.tag) == block:
            line = "".join("".join(e.itertext()) if leaf == block else (e.text or "") for e in ([b] if leaf == block else b.iter()) if leaf == block or local(e.tag) == leaf)
            if line.strip():
                lines.append(line)
    return "\n".join(lines)


def _by_number(names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


def of_size(data: bytes) -> bytes:
    """The document, unless it is too large to be read."""
    if len(data) > MOST_BYTES:
        raise ValueError("document too large")
    return data


def pages(data: bytes, extension: str) -> list[str]:
    """Text of each page: sheets, slides with notes, or the whole of a document without pages."""
    of_size(data)
    kind = extension.lower().lstrip(".")
    if kind not in ("docx", "odt", "xlsx", "pptx", "epub"):
        return [data.decode("utf-8", "replace")]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if kind == "docx":
            return [_texts(z.read("word/document.xml"), "t", "p")]
        if kind == "odt":
            return [_texts(z.read("content.xml"), "p", "p")]
        if kind == "epub":
            parts = [re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in _by_number([n for n in names if n.endswith((".xhtml", ".html", ".htm"))])]
            return ["\n".join(" ".join(p.split()) for p in parts)]
        if kind == "pptx":
            slides = _by_number([n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)])
            out = []
            for n in slides:
                note = n.replace("slides/slide", "notesSlides/notesSlide")
                out.append("\n".join([_texts(z.read(n), "t", "p"), *([_texts(z.read(note), "t", "p")] if note in names else [])]))
            return out
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(e.itertext()) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if e.tag.endswith("}si")]
        out = []
        for n in _by_number([n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]):
            rows = []
            for row in ElementTree.fromstring(z.read(n)).iter():
                if row.tag.endswith("}row"):
                    cells = []
                    for c in row:
                        v = next((e.text or "" for e in c.iter() if e.tag.endswith(("}v", "}t"))), "")
                        cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                    rows.append("\t".join(cells))
            out.append("\n".join(rows))
        return out


def media_names(data: bytes) -> list[str]:
    """Embedded pictures of an office file, sorted by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return sorted(n for n in z.namelist() if re.search(r"/media/[^/]+\.(png|jpe?g|gif|bmp|webp)$", n.lower()))


# --- code blocks


@dataclass(frozen=True)
class CodeBlock:
    code: str
    language: str
    line_start: int
    line_end: int
    context: str


def markdown_blocks(text: str) -> list[CodeBlock]:
    """Fenced blocks with their language and the last heading and line of prose before them."""
    out, lines, heading, prose, start = [], text.split("\n"), "", "", None
    language = ""
    for k, line in enumerate(lines, 1):
        if start is None and (m := re.match(r"```\s*(\w*)", line)):
            start, language = k, m[1]
        elif start is not None and line.startswith("```"):
            out.append(CodeBlock("\n".join(lines[start : k - 1]), language, start + 1, k - 1, " ".join(x for x in (heading, prose) if x)))
            start = None
        elif start is None and line.startswith("#"):
            heading, prose = line.lstrip("# ").strip(), ""
        elif start is None and line.strip():
            prose = line.strip()
    return out


def rst_blocks(text: str) -> list[CodeBlock]:
    """Bodies of code-block directives, by indentation."""
    out, lines, k, prose = [], text.split("\n"), 0, ""
    while k < len(lines):
        if m := re.match(r"(\s*)\.\. code(?:-block)?::\s*(\S*)", lines[k]):
            depth, first, body = len(m[1]), k + 1, []
            while first < len(lines) and (not lines[first].strip() or lines[first].lstrip().startswith(":")):
                first += 1
            end = first
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                body.append(lines[end])
                end += 1
            while body and not body[-1].strip():
                body.pop()
            if body:
                margin = min(len(x) - len(x.lstrip()) for x in body if x.strip())
                out.append(CodeBlock("\n".join(x[margin:] for x in body), m[2], first + 1, first + len(body), prose))
            k = max(end, k + 1)
            continue
        if lines[k].strip():
            prose = lines[k].strip()
        k += 1
    return out


def is_documentation(path: str) -> bool:
    return posixpath.splitext(path)[1].lower() in (".md", ".rst", ".mdx", ".adoc")


def is_example(path: str) -> bool:
    return any(p in ("example", "examples", "sample", "samples", "demo", "demos", "tutorial", "tutorials") for p in path.lower().split("/")[:-1])


# --- answers of models


def first_json(text: str) -> str | None:
    """The first balanced JSON object of a text; braces inside strings do not count."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[start : k + 1]
    return None


# --- page trees


@dataclass
class WikiPage:
    slug: str
    title: str
    content: str = ""
    children: list[WikiPage] = field(default_factory=list)


def parse_wiki(text: str) -> list[WikiPage]:
    def build(p: dict) -> WikiPage:
        return WikiPage(p["slug"], p.get("title", ""), p.get("content", ""), [build(c) for c in p.get("children") or []])

    return [build(p) for p in json.loads(text).get("pages", [])]


def wiki_json(pages: list[WikiPage]) -> str:
    def flat(p: WikiPage) -> dict:
        return {"slug": p.slug, "title": p.title, "content": p.content, "children": [flat(c) for c in p.children]}

    return json.dumps({"pages": [flat(p) for p in pages]}, ensure_ascii=False)


def flatten(pages: list[WikiPage], above: str = "", depth: int = 0) -> list[tuple[str, str, str, int]]:
    """(slug, path, title, depth) in pre-order."""
    out = []
    for p in pages:
        path = f"{above}/{p.slug}" if above else p.slug
        out += [(p.slug, path, p.title, depth), *flatten(p.children, path, depth + 1)]
    return out


def rebuild(rows: list[tuple[str, str, str, int]]) -> list[WikiPage]:
    """The tree of flattened rows."""
    roots: list[WikiPage] = []
    stack: list[WikiPage] = []
    for slug, _, title, depth in rows:
        page = WikiPage(slug, title)
        del stack[depth:]
        (stack[-1].children if stack else roots).append(page)
        stack.append(page)
    return roots


def path_index(pages: list[WikiPage]) -> dict[str, str]:
    """Path by slug; the first page of a slug wins."""
    out: dict[str, str] = {}
    for slug, path, _, _ in flatten(pages):
        out.setdefault(slug, path)
    return out


def find_page(pages: list[WikiPage], path: str) -> WikiPage | None:
    head, _, rest = path.strip("/").partition("/")
    for p in pages:
        if p.slug == head:
            return find_page(p.children, rest) if rest else p
    return None


def table_of_contents(pages: list[WikiPage]) -> str:
    return "\n".join(f"{'  ' * depth}- [{title}]({path})" for _, path, title, depth in flatten(pages))


def rewrite_links(text: str, paths: dict[str, str], prefix: str = "") -> str:
    """Markdown links to known slugs lead to their paths; web, absolute and unknown ones stay."""

    def replace(m: re.Match) -> str:
        target = m[2]
        slug = target.removesuffix(".md").strip("./")
        if target.startswith(("http://", "https://", "/")) or slug not in paths:
            return m[0]
        return f"[{m[1]}]({prefix}{paths[slug]})"

    return re.sub(r"\[([^\]]*)\]\(([^)]*)\)", replace, text)


# --- service maps


def compose_edges(services: dict[str, dict]) -> list[tuple[str, str, str]]:
    """(service, other, why) from a compose file's services: dependencies and URLs in the environment."""
    out = []
    for name, spec in services.items():
        needs = spec.get("depends_on") or []
        out += [(name, other, "depends_on") for other in needs]
        env = spec.get("environment") or []
        values = env.values() if isinstance(env, dict) else [str(e).partition("=")[2] for e in env]
        for value in map(str, values):
            for host in re.findall(r"\w+://(?:[^@/\s]*@)?([\w.-]+)", value):
                if host in services and host != name and (name, host, "url") not in out:
                    out.append((name, host, "url"))
    return out


def service_ports(spec: dict) -> list[int]:
    """Ports that a service exposes inside its network."""
    found = []
    for p in spec.get("ports") or []:
        text = str(p.get("target") if isinstance(p, dict) else p).split("/")[0]
        if (last := text.rsplit(":", 1)[-1]).isdigit():
            found.append(int(last))
    return found


def protocol_of(port: int) -> str:
    known = {80: "HTTP", 443: "HTTPS", 8080: "HTTP", 5432: "PostgreSQL", 3306: "MySQL", 6379: "Redis", 27017: "MongoDB", 9092: "Kafka", 5672: "AMQP"}
    return known.get(port, "TCP")


def compose_services(text: str) -> dict[str, dict]:
    """The services of a compose file; none where it is not one, or without a YAML parser."""
    try:
        import yaml
    except ImportError:
        return {}
    try:
        found = (yaml.safe_load(text) or {}).get("services")
    except (yaml.YAMLError, AttributeError):
        return {}
    return {name: spec or {} for name, spec in found.items()} if isinstance(found, dict) else {}


def architecture_text(text: str) -> str:
    """What a compose file tells about services, their ports and protocols, and who calls whom; empty if nothing."""
    services = compose_services(text)
    if not services:
        return ""
    shown = []
    for name, spec in sorted(services.items()):
        ports = ", ".join(f"{p} ({protocol_of(p)})" for p in service_ports(spec))
        made = spec.get("image") or ("built here" if spec.get("build") else "")
        shown.append(f"- {name}" + (f": {made}" if made else "") + (f", ports {ports}" if ports else ""))
    edges = [f"- {a} -> {b} ({why})" for a, b, why in compose_edges(services)]
    return "\n".join(["Services", *shown, *(["Connections", *edges] if edges else [])])


def schema_text(files: list[tuple[str, str]], per_file: int = 2000, most: int = 10_000) -> str:
    """Files that look like schemas, each cut, up to so many bytes in all."""
    hit = re.compile(r"(^|/)(migrations?|schemas?|models?|db)/|\.(sql|prisma|graphql|proto)$|schema", re.I)
    out, used = [], 0
    for path, text in sorted(files):
        if hit.search(path) and used < most:
            part = f"--- {path}\n{text[:per_file]}"
            out.append(part)
            used += len(part.encode())
    return "\n".join(out)


def gather_context(files: dict[str, str], digests: list[str] = (), readme: int = 3000, manifest: int = 500, paths: int = 200, digest: int = 2000) -> str:
    """What a generator is told of a repository: readme, manifests, file tree and earlier findings."""
    manifests = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "requirements.txt", "Gemfile", "composer.json")
    parts = [f"README\n{t[:readme]}" for p, t in sorted(files.items()) if posixpath.basename(p).lower().startswith("readme")][:1]
    parts += [f"{p}\n{t[:manifest]}" for p, t in sorted(files.items()) if posixpath.basename(p) in manifests]
    parts.append("Files\n" + "\n".join(sorted(files)[:paths]))
    parts += [d[:digest] for d in digests]
    return "\n\n".join(parts)
