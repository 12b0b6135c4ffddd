"""Text of PDF pages, for files whose fonts say what their codes mean.

Streams may be plain or deflated, objects plain or in object streams. Codes are read by a font's
ToUnicode table, else as Windows Latin 1. Encrypted files and scans have no text here; whoever needs
more registers an extractor of their own.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]+|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    """The bytes of an object's stream, inflated if it says so; empty without one."""
    m = re.search(rb"\bstream\r?\n", body)
    if not m:
        return b""
    data = body[m.end() : body.rfind(b"endstream")]
    if b"FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(data)
    return data


class _File:
    def __init__(self, data: bytes) -> None:
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("an encrypted PDF")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.split(b"stream", 1)[0]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        head, data = body.split(b"stream", 1)[0], _stream(body)
        first, count = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
        numbers = list(map(int, data[:first].split()))[: 2 * count]
        starts = [first + o for o in numbers[1::2]] + [len(data)]
        for k, number in enumerate(numbers[::2]):
            self.objects.setdefault(number, data[starts[k] : starts[k + 1]])

    def value(self, body: bytes, name: bytes) -> bytes:
        """What follows a name in a dictionary: a dictionary, a list, a reference's object or a word."""
        m = re.search(rb"/%s\b\s*" % name, body)
        if not m:
            return b""
        rest = body[m.end() :]
        if r := re.match(rb"(\d+)\s+\d+\s+R", rest):
            return self.objects.get(int(r[1]), b"")
        if rest[:2] == b"<<":
            depth = 0
            for t in re.finditer(rb"<<|>>", rest):
                depth += 1 if t[0] == b"<<" else -1
                if not depth:
                    return rest[: t.end()]
        if rest[:1] == b"[":
            return rest[: rest.index(b"]") + 1]
        return rest.split(None, 1)[0] if rest.split() else b""

    def references(self, body: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/%s\b\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % name, body)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[tuple[bytes, bytes]] = []

        def walk(body: bytes, inherited: bytes, seen: frozenset[int]) -> None:
            resources = self.value(body, b"Resources") or inherited
            kids = self.references(body, b"Kids")
            if re.search(rb"/Type\s*/Page\b(?!s)", body):
                out.append((body, resources))
            for k in kids:
                if k in self.objects and k not in seen:
                    walk(self.objects[k], resources, seen | {k})

        walk(self.value(root, b"Pages"), b"", frozenset())
        return out

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """By name: bytes a code, and what codes mean."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            font = self.objects.get(int(number), b"")
            table = _stream(self.value(font, b"ToUnicode"))
            out[name] = (2 if b"/Type0" in font else 1, _meanings(table))
        return out


def _meanings(table: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for code, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = text(value)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for low, high, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            base = text(value)
            for k in range(int(high, 16) - int(low, 16) + 1):
                out[int(low, 16) + k] = base[:-1] + chr(ord(base[-1]) + k)
    return out


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _shown(data: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out, held, width, meanings, name = [], [], 1, {}, b""

    def words(strings: list[bytes]) -> str:
        parts = []
        for raw in strings:
            codes = [int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)]
            parts.append("".join(meanings.get(c) or bytes([c & 255]).decode("cp1252", "replace") for c in codes))
        return "".join(parts)

    for m in _TOKEN.finditer(data):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            held.append(_bytes(token))
        elif token[:1] == b"/":
            name = token[1:]
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            # a wide gap inside a list of strings is a blank
            if held and float(token) < -180:
                held.append(b"\x00 " if width == 2 else b" ")
        elif token == b"Tf":
            width, meanings = fonts.get(name, (1, {}))
            held = []
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if token in (b"'", b'"') else "") + words(held))
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            held = []
        elif token not in (b"[", b"]"):
            held = []
    return "\n".join(line for line in (x.strip() for x in "".join(out).split("\n")) if line)


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, a line for each line of the page; a page without text is empty."""
    file = _File(data)
    out = []
    for page, resources in file.pages():
        content = b"\n".join(_stream(file.objects.get(n, b"")) for n in file.references(page, b"Contents"))
        out.append(_shown(content, file.fonts(resources)))
    return out
