"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items form one automaton. A document's words are streamed through it,
and after each word the automaton tells the longest run of words ending there that some item holds.
Where that run is as long as a window, its last words are a window of an item, and its state knows which
items. Nothing but the current state is kept, so a text of any length takes memory for its words alone.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, Scratch, by_batch, by_group, drop_materialized, materialize

#: A word is a run of digits, lower-case a-z and all beyond ASCII; A-Z count as a-z. Bytes beyond 127
#: belong to characters beyond ASCII, so one table over UTF-8 bytes lower-cases and blanks what is between.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words of items in one automaton, which is broadcast: some 60 MB in a worker. More items make more automata.
MOST_WORDS = 100_000


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """States of the suffixes of all items: transitions, suffix link, longest length, items by state.

    ``windows`` has the items of a state's run of ``width`` words; ``short`` the items of fewer words
    that end wherever the state's run ends, as (words, item), nearest first.
    """

    width: int
    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    windows: dict[int, list[int]] = field(default_factory=dict)
    short: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _new(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The part of state ``q`` that is reached from ``p``, as a state of its own."""
        part = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = part
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.step[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        now, p = self._new({}, 0, self.length[last] + 1), last
        while p != -1 and word not in self.step[p]:
            self.step[p][word] = now
            p = self.link[p]
        if p != -1:
            q = self.step[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return now

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def mark(self, items: Iterable[tuple[int, list[bytes]]]) -> None:
        """Give states their items, once all words are in."""
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            if len(words) < self.width:
                state = 0
                for w in words:
                    state = self.step[state][w]
                ends.setdefault(state, []).append((len(words), item))
                continue
            for _, state in self.runs(words):
                if not (known := self.windows.setdefault(state, [])) or known[-1] != item:
                    known.append(item)
        if ends:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if found := ends.get(state, []) + self.short.get(self.link[state], []):
                    self.short[state] = found

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(position, state) of each word at which a window ends; the state is that of the window itself."""
        step, link, length, width = self.step, self.link, self.length, self.width
        state = have = 0
        for at, w in enumerate(words):
            after = step[state].get(w)
            while after is None and state:
                state = link[state]
                have = length[state]
                after = step[state].get(w)
            if after is None:
                continue
            state = after
            have += 1
            if have >= width:
                # no more than the window is kept: what is longer matters only by its windows
                while length[link[state]] >= width:
                    state = link[state]
                have = width
                yield at, state

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges (from, upto) of words inside windows, apart and in order, and the items of those windows."""
        ranges: list[list[int]] = []
        items: set[int] = set()
        if self.short:
            hits = self._with_short(words, items)
        else:
            hits = self._long(words, items)
        for start, upto in hits:
            while ranges and ranges[-1][0] >= start:
                ranges.pop()
            if ranges and ranges[-1][1] >= start:
                ranges[-1][1] = upto
            else:
                ranges.append([start, upto])
        return [(a, b) for a, b in ranges], items

    def _long(self, words: list[bytes], items: set[int]) -> Iterator[tuple[int, int]]:
        for at, state in self.runs(words):
            items.update(self.windows[state])
            yield at + 1 - self.width, at + 1

    def _with_short(self, words: list[bytes], items: set[int]) -> Iterator[tuple[int, int]]:
        """As ``_long``, and where whole short items end."""
        step, link, length, width, short = self.step, self.link, self.length, self.width, self.short
        state = have = 0
        for at, w in enumerate(words):
            after = step[state].get(w)
            while after is None and state:
                state = link[state]
                have = length[state]
                after = step[state].get(w)
            if after is None:
                continue
            state = after
            have += 1
            longest = 0
            for size, item in short.get(state, ()):
                if size <= have:
                    items.add(item)
                    longest = max(longest, size)
            if have >= width:
                while length[link[state]] >= width:
                    state = link[state]
                have = width
                items.update(self.windows.get(state, ()))
                longest = width
            if longest:
                yield at + 1 - longest, at + 1


def build(items: list[tuple[int, list[bytes]]], width: int) -> Automaton:
    """The automaton of (item number, words)."""
    out = Automaton(width)
    for _, words in items:
        out.add(words)
    out.mark(items)
    return out


def automata(items: DataFrame, width: int, most_words: int) -> DataFrame:
    """part, names, automaton: the items of each part as an automaton, and the ids its item numbers stand for.

    Items are dealt by a hash into parts of about ``most_words`` words, one of more words in pieces that
    overlap by a window less one word, so no window is lost. Each part is built by a task of its own.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text) if text else []
            for at in range(0, max(1, len(words) - width + 1), most_words) if words else ():
                piece = words[at : at + most_words + width - 1]
                out.append((item, b" ".join(piece), len(piece)))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["id", "words", "n"])

    def make(table: pa.Table) -> pa.RecordBatch:
        names, words = (table.column(c).to_pylist() for c in ("id", "words"))
        built = build([(k, w.split()) for k, w in enumerate(words)], width)
        return pa.RecordBatch.from_arrays([pa.array([table.column("part")[0].as_py()]), pa.array([names], pa.list_(pa.string())), pa.array([pickle.dumps(built)], pa.binary())], names=["part", "names", "automaton"])

    pieces = items.select(F.col("item_id").cast("string").alias("id"), "text").mapInArrow(by_batch(cut), "id string, words binary, n long").distinct()
    pieces = materialize(pieces, "benchmark-words")
    parts = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // most_words) or 1
    dealt = pieces.select(F.pmod(F.xxhash64("id", "words"), F.lit(parts)).alias("part"), "id", "words").repartition("part").sortWithinPartitions("part", "id", "words")
    built = materialize(dealt.mapInArrow(by_group(make, 1), "part long, names array<string>, automaton binary"), "benchmark-automata")
    drop_materialized(pieces)
    return built


def _find(words: list[bytes], known: tuple[list[str | None], Automaton] | None) -> tuple[list[tuple[int, int]], list[str]]:
    """Ranges of words inside windows, and the ids of the items they are of, sorted."""
    if not known or not words:
        return [], []
    ranges, found = known[1].find(words)
    return ranges, sorted({known[0][k] for k in found} - {None})


_RANGES = pa.list_(pa.list_(pa.int64()))


def matches(docs: DataFrame, items: DataFrame, width: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, text_hash, n_words, ranges, items of each row: word ranges inside windows, and item ids as text.

    Items of up to ``most_words`` words make one automaton, and the texts are scanned once. Beyond, each
    automaton scans them again, only rows with windows leave those scans, and the ranges of a row's
    (doc_id, hash of the text) are joined. Texts are never shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def scan(known: Broadcast | None) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ranges, found = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text) if text else []
                here, names = _find(words, known.value if known else None)
                n.append(len(words))
                ranges.append(here)
                found.append(names)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ranges, _RANGES), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "ranges", "items"])

        return rows.mapInArrow(by_batch(run), f"doc_id {kind}, text_hash long, n_words long, ranges array<array<long>>, items array<string>")

    known = list(_shared(items, width, most_words))
    out = scan(known[0] if known else None)
    if len(known) < 2:
        return out
    scratch = Scratch()
    out = scratch(out, "windows")
    found = reduce(DataFrame.unionByName, [out, *(scan(k) for k in known[1:])]).where(F.size("ranges") > 0)
    every = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ranges")))).alias("_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    every = scratch(every.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "windows-of-all")
    joined = out.join(every, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    united = _united(F.coalesce("_ranges", F.array().cast("array<array<long>>")))
    return scratch.finish(joined.select("doc_id", "text_hash", "n_words", united.alias("ranges"), F.coalesce("_items", F.array().cast("array<string>")).alias("items")), "windows")


def _shared(items: DataFrame, width: int, most_words: int) -> Iterator[Broadcast]:
    """Each automaton as a broadcast of bounded size, one after the other."""
    spark, built = items.sparkSession, automata(items, width, most_words)
    for part in [r["part"] for r in built.select("part").orderBy("part").collect()]:
        row = built.where(F.col("part") == part).first()
        yield spark.sparkContext.broadcast((row["names"], pickle.loads(row["automaton"])))
    drop_materialized(built)


def _united(ranges: Column) -> Column:
    """Sorted ranges joined where they touch."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(r, F.lit(1))))))
        return F.when((F.size(done) > 0) & (F.get(F.try_element_at(done, F.lit(-1)), F.lit(1)) >= F.get(r, F.lit(0))), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast("array<array<long>>"), add)


def find_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every whole text.

    A window is ``width`` consecutive words of an item, or all words of a shorter one; a word inside any
    occurrence of a window is hit. ``items_sha256`` is of the item ids whose windows occur, as text,
    sorted and joined by commas. Null, empty and wordless texts have no words, and such items no windows.
    Windows of items without id count as hits, but such items have no id to be listed or counted by; items that
    repeat an id count as one. Each row of ``docs`` is judged by itself. Empty tables give empty or clean
    results; other columns are ignored.
    """
    found = matches(docs, items, width, most_words)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))


def remove_leaks(docs: DataFrame, items: DataFrame, width: int = 10, longest: int = 10, most_share: float = 0.5, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs``, all columns kept, without the spans that items share and without rows that are mostly such spans.

    A span is a run of words inside windows. Spans of at least ``longest`` words are cut out of the text with
    what stands between their words; rows more than ``most_share`` of whose words are in windows go. Other
    rows stay as they are, null and wordless texts among them.
    """
    at, width_of_row = docs.columns.index("text"), len(docs.columns)
    scratch = Scratch()
    found = matches(docs, items, width, most_words).where(F.size("ranges") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_words").alias("_n"), F.col("ranges").alias("_ranges"))
    found = scratch(found.dropDuplicates(["_id", "_hash"]), "spans")
    size = found.agg(F.sum(F.size("_ranges") + 1)).first()[0] or 0
    few = F.broadcast(found) if size <= MOST_BROADCAST else found
    joined = docs.join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash")), "left")
    hit = F.aggregate("_ranges", F.lit(0).cast("long"), lambda total, r: total + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    joined = joined.where(F.col("_ranges").isNull() | (hit <= F.col("_n") * most_share)).select(*docs.columns, "_ranges")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        for k, ranges in enumerate(batch.column(width_of_row).to_pylist()):
            if ranges:
                texts[k] = without(texts[k], [(a, b) for a, b in ranges if b - a >= longest])
        columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return scratch.finish(joined.mapInArrow(by_batch(cut), docs.schema), "without-leaks")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text without the words of the ranges and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept, done = [], 0
    for a, b in ranges:
        kept.append(raw[done : words[a][0]])
        done = words[b - 1][1]
    return b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass")
