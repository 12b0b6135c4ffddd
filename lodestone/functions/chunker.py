"""Splitting texts into overlapping, line-aware chunks, and documents into request batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes count code points."""

    size: int = 1500
    overlap: int = 200
    least: int = 50

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size or not 0 <= self.least <= self.size:
            raise ValueError("size > 0, 0 <= overlap < size and 0 <= least <= size must hold")


@dataclass(frozen=True)
class Chunk:
    content: str
    offset: int
    start_line: int
    end_line: int


def _width(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """Windows of ``size`` code points with their byte offset; a last one inside the overlap is dropped."""
    for start in range(0, len(text), size - overlap):
        piece = text[start : start + size]
        if start and len(piece) <= overlap:
            return
        yield piece, _width(text[:start])


def long_line(line: str, size: int, overlap: int) -> Iterator[tuple[str, int]]:
    """A line longer than a chunk: packed by blanks; a token that is too long goes by windows."""
    tokens = [t for t in re.findall(r"[^ \t]*[ \t]*", line) if t]
    if len(tokens) == 1:
        yield from windows(line, size, overlap)
        return
    held, at = "", 0
    for token in tokens:
        if len(token) > size:
            if held:
                yield held, at
            at += _width(held)
            for piece, offset in windows(token, size, overlap):
                yield piece, at + offset
            at, held = at + _width(token), ""
        elif len(held) + len(token) > size:
            yield held, at
            at, held = at + _width(held), token
        else:
            held += token
    if held:
        yield held, at


def chunks(text: str, config: ChunkConfig = ChunkConfig()) -> list[Chunk]:
    """Chunks of whole lines that share trailing lines up to the overlap.

    Size is tested before lines of the last chunk are carried over, so a chunk can exceed it by them.
    """
    found: list[tuple[str, int]] = []
    held: list[str] = []
    count, at = 0, 0

    def close() -> None:
        if count >= config.least and held:
            found.append(("".join(held), at))

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if len(line) > config.size:
            close()
            at += _width("".join(held))
            held, count = [], 0
            found += [(piece, at + offset) for piece, offset in long_line(line, config.size, config.overlap) if len(piece) >= config.least]
            at += _width(line)
            continue
        if held and count + len(line) > config.size:
            close()
            at += _width("".join(held))
            kept, room = 0, config.overlap
            while kept < len(held) and len(held[-1 - kept]) <= room:
                room -= len(held[-1 - kept])
                kept += 1
            held = held[len(held) - kept :]
            count = config.overlap - room
            at -= _width("".join(held))
        held.append(line)
        count += len(line)
    close()
    raw, out = text.encode("utf-8", "surrogatepass"), []
    for content, offset in found:
        start = 1 + raw.count(b"\n", 0, offset)
        out.append(Chunk(content, offset, start, max(start, start + content.count("\n") - content.endswith("\n"))))
    return out


def batches(lengths: Sequence[int], most_chars: int = 16_000, most_rows: int = 1) -> list[int]:
    """The batch number of each document, in order: a batch closes when a document would not fit."""
    out, batch, rows, chars = [], 0, 0, 0
    for n in lengths:
        weight = min(n, most_chars)
        if rows and (rows >= most_rows or chars + weight > most_chars):
            batch, rows, chars = batch + 1, 0, 0
        out.append(batch)
        rows, chars = rows + 1, chars + weight
    return out
