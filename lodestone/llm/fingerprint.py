"""Document fingerprints: canonical exact digests.

A text is folded (NFKC, case, white space), and the fingerprint is the 128-bit xxhash of what is
left. Texts that share a hash are compared byte by byte; should two differ, the fingerprints of
that hash get a suffix that tells them apart.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_batch, pieces_of, small, texts

#: Hex digits of the hash.
DIGITS = 32


def canonical(text: str) -> bytes:
    """NFKC, case folded and composed again, runs of white space as one blank, none at the ends."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes, digits: int = DIGITS) -> str:
    return xxhash.xxh3_128_hexdigest(data)[:digits]


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def hashed(docs: DataFrame, digits: int) -> DataFrame:
    """doc_id, fingerprint and sum (the SHA-256 of the canonical text) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        canon = [canonical(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(c, digits) for c in canon], pa.string()), pa.array([hashlib.sha256(c).digest() for c in canon], pa.binary())], names=["doc_id", "fingerprint", "sum"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, sum binary")


def collisions(docs: DataFrame, narrow: DataFrame, digits: int) -> DataFrame:
    """(fingerprint): hashes that different canonical texts of ``docs`` share, by their bytes.

    ``narrow`` holds doc_id and fingerprint of the same rows. Only texts whose ids stand in a repeated
    bucket are read again, by a join on the id, which is a broadcast as long as these ids are few. The
    least and the greatest canonical text of a bucket are aggregated, which combines on the map side,
    so a bucket with a third of all rows is one row a task; if both are equal, all are.
    """
    repeated = narrow.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    again = narrow.join(small(repeated), "fingerprint", "left_semi")
    # a null id meets no join: such rows are read whatever their bucket
    wanted = small(again.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct())

    def bytes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        canon = [canonical(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array([digest(c, digits) for c in canon], pa.string()), pa.array(canon, pa.binary())], names=["fingerprint", "canon"])

    rows = docs.select("doc_id", "text")
    rows = rows.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(rows.where("doc_id IS NULL"))
    buckets = rows.select("text").mapInArrow(by_batch(bytes_of), "fingerprint string, canon binary")
    return buckets.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("fingerprint")


def _told_apart(rows: DataFrame, differing: DataFrame, name: str, total: str) -> DataFrame:
    """``rows`` with the sum as a suffix of the fingerprints in column ``name`` that are in ``differing``."""
    hit = small(differing.select(F.col("fingerprint").alias("_hit")))
    told = F.when(F.col("_hit").isNotNull(), F.concat(name, F.lit("-"), F.lower(F.hex(total)))).otherwise(F.col(name))
    return rows.join(hit, F.col(name) == F.col("_hit"), "left").withColumn(name, told).drop("_hit")


def fingerprint(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id and fingerprint of every whole text.

    Null texts count as empty. Equal canonical texts have equal fingerprints, others different ones.
    """
    scratch = Scratch()
    narrow = scratch(hashed(docs, digits), "hashes")
    differing = scratch(collisions(docs, narrow, digits), "collisions")
    return scratch.finish(_told_apart(narrow, differing, "fingerprint", "sum").select("doc_id", "fingerprint"), "fingerprints")


_EDITS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "sum", "edited_sum")


def _lines(rows: list[tuple], kind: pa.DataType, digits: int) -> pa.RecordBatch:
    """What is told of (doc_id, text, next text) each."""
    out = []
    for _, text, following in rows:
        canon, changed = canonical(text), edited(text, following)
        other = canonical(changed)
        out.append((len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(canon, digits), digest(other, digits), float(canon == other), float(canon == canonical(following)), hashlib.sha256(canon).digest(), hashlib.sha256(other).digest()))
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
    columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *columns], names=["doc_id", *_EDITS])


def fingerprint_edits(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness (0 or 1).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the next by (doc_id, hash of the text), nulls first, and after the last
    comes the first; a single row is its own next. Null texts count as empty. Rows that repeat an
    id are each followed by the next row. An empty table gives an empty result; other columns are
    ignored. doc_id is a number. ``digits`` of the hash are kept.

    Texts are shuffled once, into sorted ranges that Spark cuts by a sample of (doc_id, hash of the
    text, number of the row), so a repeated id is many ranges. The rows at the edges of ranges, two a
    range, are written with their texts and meet the next range's in a second, small step.

    Fingerprints of different texts that share a hash get the SHA-256 as a suffix. Buckets of the
    original texts are compared by their bytes; edited texts, which exist only while they are
    scanned, by their SHA-256.
    """
    scratch, parts = Scratch(), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "_hash", "_number"]
    ranges = rows.withColumns({"_hash": F.xxhash64("text"), "_number": F.monotonically_increasing_id()}).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches):
        from pyspark import TaskContext

        part, waiting = TaskContext.get().partitionId(), None

        def edge(name: str, ids, text: str, id_type: pa.DataType) -> pa.RecordBatch:
            empty = _lines([], id_type, digits)
            nulls = [pa.nulls(1, c.type) for c in empty.columns[1:]]
            return pa.RecordBatch.from_arrays([pa.array([ids], id_type), *nulls, pa.array([part]), pa.array([name]), pa.array([text])], names=[*empty.schema.names, "part", "edge", "text"])

        for whole in batches:
            for batch in pieces_of(whole):
                id_type = batch.column(0).type
                here = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                if waiting is None:
                    yield edge("first", *here[0], id_type)
                else:
                    here.insert(0, waiting)
                waiting = here[-1]
                if told := [(i, t, n) for (i, t), (_, n) in zip(here, here[1:], strict=False)]:
                    out = _lines(told, id_type, digits)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([part] * len(told)), pa.nulls(len(told), pa.string()), pa.nulls(len(told), pa.string())], names=[*out.schema.names, "part", "edge", "text"])
        if waiting is not None:
            yield edge("last", *waiting, id_type)

    shape = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sum binary, edited_sum binary"
    walked = scratch(ranges.mapInArrow(walk, f"{shape}, part long, edge string, text string"), "fingerprint-ranges")

    # one row a range: its number and the next one's
    everything = Window.orderBy("part")
    following = walked.where("edge = 'first'").select("part", F.coalesce(F.lead("part").over(everything), F.first("part").over(everything)).alias("next"))
    firsts = walked.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    lasts = walked.where("edge = 'last'").select("part", "doc_id", "text").join(following, "part").join(firsts, "next").select("doc_id", "text", "next_text")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _lines(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), batch.column(0).type, digits)

    told = walked.where("edge IS NULL").select("doc_id", *_EDITS).unionByName(lasts.mapInArrow(by_batch(finish), shape))
    told = scratch(told, "fingerprint-lines")
    both = told.select("fingerprint", "sum").unionByName(told.select(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_sum").alias("sum")))
    by_sum = both.groupBy("fingerprint").agg(F.min("sum").alias("low"), F.max("sum").alias("high")).where("low <> high").select("fingerprint")
    differing = scratch(collisions(docs, told.select("doc_id", "fingerprint"), digits).unionByName(by_sum).distinct(), "collisions")
    out = _told_apart(_told_apart(told, differing, "fingerprint", "sum"), differing, "edited_fingerprint", "edited_sum")
    return scratch.finish(out.select("doc_id", *_EDITS[:-2]), "fingerprints")
