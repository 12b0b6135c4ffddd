"""Regex search by trigrams: which files can match at all, from stored postings, before any content is read.

A pattern is turned into a tree of ANDs and ORs over trigrams that every match must hold. Postings of the
rarest of them name the files that satisfy the tree; only their contents are read and matched line by line.
A pattern that requires no trigram is answered by the full scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as C  # the parse tree of a pattern is what Python's own compiler works on
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import new_only
from ..operators.tables import TableStore, Transaction
from ..session import shared_path, ship_package, source_digest, written
from . import retrieval

#: Strings that a part of a pattern may stand for before only their trigrams are kept; members of a class likewise.
MOST_STRINGS, MOST_MEMBERS = 32, 8
#: Trigrams of one AND whose postings are read, the rarest first, and files that a search may broadcast.
RAREST, MOST_FILES = 4, 250_000
#: Files of a piece, whose places are short integers; and the share of all files from which contents are matched before files are joined.
PIECE_FILES, LARGE_SHARE = 8192, 0.25
#: Bits of a trigram's number that choose its slot.
SLOT_BITS = 6

#: The files of a piece are its row of the trigram NAMES; other rows give the places in that list of the files that hold a trigram.
_POSTINGS = "gram int, piece long, places array<short>, files array<long>, slot int"
NAMES = -1


@dataclass(frozen=True)
class Need:
    """What a match must hold: all or any of the parts, or one trigram. No parts of ``all`` ask for nothing."""

    kind: str
    parts: tuple = ()
    gram: str = ""

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else {g for p in self.parts for g in p.grams()}


ANYTHING = Need("all")


def _both(needs: list[Need]) -> Need:
    parts = tuple(dict.fromkeys(p for n in needs for p in (n.parts if n.kind == "all" else (n,))))
    return parts[0] if len(parts) == 1 else Need("all", parts)


def _either(needs: list[Need]) -> Need:
    """One of the needs; if one of them is nothing, so is the whole."""
    parts = tuple(dict.fromkeys(p for n in needs for p in (n.parts if n.kind == "any" else (n,))))
    return ANYTHING if any(p == ANYTHING for p in parts) else parts[0] if len(parts) == 1 else Need("any", parts)


def _of_string(text: str) -> Need:
    # only ASCII trigrams count: others may be written in several cases or forms
    return _both([Need("gram", gram=text[i : i + 3]) for i in range(len(text) - 2) if text[i : i + 3].isascii()])


def _of_strings(strings: set[str]) -> Need:
    return _either([_of_string(s) for s in sorted(strings)])


def _members(items: list) -> set[str] | None:
    """The characters of a class, if it names a few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(_lower(value))
        elif kind is C.RANGE and value[1] - value[0] < 4 * MOST_MEMBERS:
            found.update(_lower(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    # a bracket or && inside a class means other things to other engines
    return found if len(found) <= MOST_MEMBERS and not found & {"[", "&"} else None


def _lower(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _needs(parsed) -> tuple[set[str] | None, Need]:
    """The strings that a sequence stands for, if they are few, and what a match of it must hold."""
    strings: set[str] | None = {""}
    # the strings reach back to the start of the sequence as long as nothing before them is open
    whole, held = True, []

    def follow(more: set[str]) -> None:
        nonlocal strings, whole
        longer = {s + m for s in strings for m in more}
        if len(longer) > MOST_STRINGS:
            held.append(_of_strings(strings))
            whole, longer = False, {s[-2:] + m for s in strings for m in more}
            if len(longer) > MOST_STRINGS:
                longer = {""}
        strings = longer

    def stop(need: Need = ANYTHING) -> None:
        """Something stands here that is not a few strings."""
        nonlocal strings, whole
        held.extend([_of_strings(strings), need])
        strings, whole = {""}, False

    for kind, value in parsed:
        if kind is C.LITERAL:
            follow({_lower(value)})
        elif kind is C.IN and (few := _members(value)):
            follow(few)
        elif kind is C.SUBPATTERN:
            few, need = _needs(value[3])
            follow(few) if few is not None else stop(need)
        elif kind is C.BRANCH:
            ways = [_needs(way) for way in value[1]]
            if all(few is not None for few, _ in ways) and sum(len(few) for few, _ in ways) <= MOST_STRINGS:
                follow(set().union(*(few for few, _ in ways)))
            else:
                stop(_either([_of_strings(few) if few is not None else need for few, need in ways]))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            few, need = _needs(inner)
            if few is not None and (least, most) == (0, 1) and len(few) < MOST_STRINGS:
                follow(few | {""})
            elif few is not None and least == most <= 4:
                for _ in range(least):
                    follow(few)
            elif least:
                if few is not None:
                    follow(few)
                stop(need)
            else:
                stop()
        elif kind is C.AT and value in (C.AT_BEGINNING, C.AT_END, C.AT_BOUNDARY, C.AT_NON_BOUNDARY, C.AT_BEGINNING_STRING, C.AT_END_STRING):
            pass
        else:
            stop()
    need = _both([*held, _of_strings(strings)])
    return (strings, need) if whole else (None, need)


def needed(pattern: str) -> Need:
    """What every line that matches a pattern holds, as lower-cased trigrams; :data:`ANYTHING` if nothing is certain."""
    retrieval.check_pattern(pattern)
    if re.search(r"\(\?[a-zA-Z]*x|[*+?}]\+|\(\?[>=!<(]", pattern):
        # blanks that do not count, possessive repeats, atomic groups and look-around are left to the full scan
        return ANYTHING
    return _needs(_parser.parse(pattern))[1]


def number_of(gram: str) -> int:
    """A trigram of ASCII characters as a number below 2 ** 21."""
    return ord(gram[0]) << 14 | ord(gram[1]) << 7 | ord(gram[2])


def _grams(files: DataFrame, key: str, content: str) -> DataFrame:
    """(gram, piece, places, files): which files of a piece hold a trigram, and a row of the piece's files, known by the hash of their keys.

    Trigrams are the ASCII ones of each content in lower case.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        fold = np.arange(256, dtype=np.int32)
        fold[65:91] += 32
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_FILES):
                some = batch.slice(at, PIECE_FILES)
                names, held = some.column(0).to_numpy(), []
                for k, text in enumerate(some.column(1).cast(pa.binary())):
                    codes = fold[np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)]
                    if len(codes) < 3:
                        continue
                    plain = codes < 128
                    found = np.unique((codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:])[plain[:-2] & plain[1:-1] & plain[2:]])
                    held.append(found.astype(np.int64) << 13 | k)
                pairs = np.sort(np.concatenate([*held, np.empty(0, np.int64)]))
                grams, places = (pairs >> 13).astype(np.int32), (pairs & PIECE_FILES - 1).astype(np.int16)
                starts = np.flatnonzero(np.diff(grams, prepend=-1))
                # pieces of one number are the same files in the same order
                piece, rows = xxhash.xxh64_intdigest(names.tobytes()) - (1 << 63), len(starts) + 1
                ends = np.concatenate([starts, [len(places)]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(places))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(rows, len(names))]).astype(np.int32)), pa.array(names))
                columns = [pa.array(np.concatenate([[NAMES], grams[starts]]).astype(np.int32)), pa.array(np.full(rows, piece)), lists, listed]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "piece", "places", "files"])

    return files.select(F.xxhash64(F.col(key)).alias("file"), content).mapInArrow(run, "gram int, piece long, places array<short>, files array<long>")


class GrepIndex:
    """Trigrams of (key, content) files: postings by trigram and piece of files, and how many files hold each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.store = TableStore(spark, folder)

    @property
    def exists(self) -> bool:
        return self.store.exists("postings")

    def _tables(self, files: DataFrame, key: str, content: str) -> dict[str, DataFrame]:
        grams = _grams(files, key, content).withColumn("slot", F.pmod(F.xxhash64("gram"), F.lit(1 << SLOT_BITS)).cast("int"))
        return {"postings": grams.select("gram", "piece", "places", "files", "slot").hint("rebalance", "slot").sortWithinPartitions("slot", "gram", "piece"), "files": files.select(F.xxhash64(F.col(key)).alias("file"))}

    def _publish(self, tx: Transaction, tables: dict[str, DataFrame], put) -> None:
        for name, rows in tables.items():
            put(tx)(name, rows, ["slot"] if name == "postings" else [])

    def build(self, files: DataFrame, key: str = "path", content: str = "content") -> GrepIndex:
        """Replace the index by one of these files."""
        tables = self._tables(files, key, content)
        self.store.update(lambda tx: self._publish(tx, tables, lambda t: t.replace))
        self._count()
        return self

    def add(self, files: DataFrame, key: str = "path", content: str = "content") -> int:
        """Index the files that are new; how many there were."""
        if not self.exists:
            self.build(files, key, content)
            return self.store.read("files").count()
        marked = files.withColumn("file", F.xxhash64(F.col(key)))

        def change(tx: Transaction) -> int:
            fresh = new_only(marked, tx.read("files"), "file").drop("file")
            if count := fresh.count():
                self._publish(tx, self._tables(fresh, key, content), lambda t: t.append)
            return count

        if count := self.store.update(change):
            self._count()
        return count

    def remove(self, files: DataFrame, key: str = "path") -> None:
        """Forget files by their keys; their postings stay, and the counts that choose trigrams count them."""
        self.store.delete("files", files.select(F.xxhash64(F.col(key)).alias("file")))

    def _count(self) -> None:
        def change(tx: Transaction) -> None:
            tx.replace("counts", tx.read("postings", _POSTINGS).where(F.col("gram") != NAMES).groupBy("gram").agg(F.sum(F.size("places")).alias("n")).coalesce(1))

        self.store.update(change)

    def _frequencies(self, grams: set[str]) -> dict[str, int]:
        """How many files hold each trigram; 0 for one that none holds."""
        numbers = {number_of(g): g for g in grams}
        rows = self.store.read("counts", "gram int, n long").where(F.col("gram").isin(sorted(numbers))).collect()
        return dict.fromkeys(grams, 0) | {numbers[r["gram"]]: r["n"] for r in rows}

    def candidates(self, pattern: str) -> DataFrame | None:
        """(file): hashes of the keys of all files that can match; None if the pattern requires no trigram."""
        need = needed(pattern)
        if need == ANYTHING:
            return None
        need = rarest(need, self._frequencies(need.grams()))
        grams = sorted(number_of(g) for g in need.grams())
        slots = sorted({r[0] for r in self.store.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(g).cast("int")), F.lit(1 << SLOT_BITS)).cast("int") for g in [NAMES, *grams]]))).collect()})
        state = self.store.state()
        rows = self.store.rows_of(state, "postings", _POSTINGS).where(F.col("slot").isin(slots))
        held = rows.where(F.col("gram").isin(grams)).select("gram", "piece", F.explode("places").alias("place"))
        held = held.groupBy("piece", "place").agg(F.collect_set("gram").alias("grams")).where(holds(need, F.col("grams")))
        # the same files may be added twice, as one piece
        pieces = held.groupBy("piece").agg(F.collect_set("place").alias("places")).join(rows.where(F.col("gram") == NAMES).select("piece", "files").dropDuplicates(["piece"]), "piece")
        found = pieces.select(F.explode(F.transform("places", lambda p: F.element_at("files", p.cast("int") + 1))).alias("file")).distinct()
        return found.join(self.store.rows_of(state, "files"), "file", "left_semi") if state["tables"]["files"]["gone"] else found

    def matching_lines(self, files: DataFrame, pattern: str, pathspec: str | None = None, path: str = "path", content: str = "content", key: str | None = None) -> DataFrame:
        """As ``retrieval.matching_lines``, with the same result, reading the contents of candidates alone."""
        found = self.candidates(pattern)
        if found is None:
            return retrieval.matching_lines(files, pattern, pathspec, path, content)
        found, hashed = written(found, "candidates"), F.xxhash64(F.col(key or path))
        count = found.count()
        few = F.broadcast(found) if count <= MOST_FILES else found
        if count > MOST_FILES and count > LARGE_SHARE * self.store.read("files").count() and key in (None, path):
            # so many files are matched where they lie, and only their matches travel
            return retrieval.matching_lines(files, pattern, pathspec, path, content).join(few, hashed == few["file"], "left_semi")
        return retrieval.matching_lines(files.join(few, hashed == few["file"], "left_semi"), pattern, pathspec, path, content)

    def grep(self, files: DataFrame, pattern: str, pathspec: str | None = None, most_files: int = 10, most_matches: int = 1000, path: str = "path", content: str = "content") -> DataFrame:
        """As ``retrieval.grep``, with the same result."""
        return retrieval.grouped_matches(self.matching_lines(files, pattern, pathspec, path, content), most_files, most_matches, path)


def rarest(need: Need, often: dict[str, int]) -> Need:
    """The need with only the RAREST trigrams of each AND, which more files may satisfy but none fewer."""
    if need.kind == "gram":
        return need
    parts = [rarest(p, often) for p in need.parts]
    if need.kind == "all":
        grams = sorted((p for p in parts if p.kind == "gram"), key=lambda p: (often[p.gram], p.gram))
        parts = [*grams[:RAREST], *(p for p in parts if p.kind != "gram")]
    return Need(need.kind, tuple(parts))


def holds(need: Need, grams: Column) -> Column:
    """A file's set of trigram numbers satisfies the need."""
    if need.kind == "gram":
        return F.array_contains(grams, F.lit(number_of(need.gram)))
    parts = [holds(p, grams) for p in need.parts]
    return reduce(lambda a, b: a & b if need.kind == "all" else a | b, parts)


def shared_grep(files: DataFrame, key: str = "path", content: str = "content") -> GrepIndex:
    """The index of a table that is stored in files, in the shared folder; built once for the files as they are."""
    index = GrepIndex(files.sparkSession, shared_path(files, f"grep {source_digest(__name__)} {key} {content}"))
    return index if index.exists and index.store.exists("counts") else index.build(files, key, content)
