"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Documents with equal shingle sets form a class, and only one document of a class is compared.
Bands of MinHash values propose candidates. The MinHash samples of a document are folded into a
parity bitmap (odd sketch); the population count of two bitmaps' XOR estimates how many samples
differ, which rules out nearly all candidates below the threshold without their sets. What is
left is confirmed on the full sets.

Links only matter for what they connect, so members of a bucket are first compared with one of
them (a star, linear in the bucket). Where components are still apart, all pairs across them are
compared in tiles: by sketches to find families, then by full sets inside a family. Only spanning
forests leave a tile, never pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_batch, by_group, in_tiles, join_groups, join_partners, materialize, merge, small
from .components import components, named

BANDS, ROWS, SKETCH_WORDS = 30, 5, 8
SAMPLES, SKETCH_BITS = BANDS * ROWS, 64 * SKETCH_WORDS
MEMORY = 300_000
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes.

    A-Z are lower-cased and words split at blanks and tab to carriage return. With fewer words than
    ``size`` the whole sequence is one shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = (total + h[k : len(h) - width + 1 + k]) * _PLACES[k % len(_PLACES)]
    return np.unique(_mix(total))


def minhash(values: np.ndarray) -> np.ndarray:
    """SAMPLES minima of the set under multiplicative hashes, in slices of bounded memory."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        best = np.minimum(best, np.multiply.outer(_FACTORS, values[at : at + 2048]).min(axis=1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; keys of different bands differ."""
    mixed = (samples.reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return _mix(mixed + _mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as SKETCH_WORDS 64-bit words."""
    at = (_mix(samples + _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.uint64)


def estimate(differing_bits: int) -> float:
    """The Jaccard similarity that an odd sketch pair's XOR population count stands for."""
    share = min(2 * differing_bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(1 - share)


def most_bits(similarity: float, sigmas: float = 6.5) -> int:
    """The XOR population count above which a pair is ruled out: far beyond chance at ``similarity``."""
    low = similarity - sigmas * math.sqrt(similarity * (1 - similarity) / SAMPLES)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - low))))


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_digest, bands, sketch of every whole text; empty sets have no digest."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        hashes = WordHashes()
        none = np.zeros(0, dtype=np.uint64)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digests, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                values = shingles(text or "", size, hashes)
                n.append(len(values))
                if len(values):
                    samples = minhash(values)
                    digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                else:
                    digests.append(None)
                    bands.append(none)
                    sketches.append(none)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _longs(bands), _longs(sketches)], names=["doc_id", "n_shingles", "set_digest", "bands", "sketch"])

        return by_batch(one)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_digest binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, members): the full shingle sets of the classes in ``wanted`` (node, id, set_digest).

    Texts are chosen by a join on their ids before their shingles are formed. Up to MOST_BROADCAST ids
    it is a broadcast and no text is shuffled; beyond, the texts of all rows are shuffled by id, once.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        hashes = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [shingles(t or "", size, hashes) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in values], pa.binary()), _longs(values)], names=["id", "set_digest", "members"])

        return by_batch(one)(batches)

    rows = docs.select(F.col("doc_id").alias("id"), "text").join(small(wanted.select("id").distinct()), "id", "left_semi")
    found = rows.mapInArrow(run, f"id {kind}, set_digest binary, members array<long>")
    return found.join(small(wanted.select("id", "set_digest", "node")), ["id", "set_digest"]).dropDuplicates(["node"]).select("node", "members")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, pivot: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``pivot`` is the side that many pairs share."""
    other = "b" if pivot == "a" else "a"
    mine, theirs = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in (pivot, other))
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = join_partners(pairs, mine, pivot, other, scratch).join(theirs, other)
    return met.where(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent).select("a", "b")


def _likely(sa: Column, sb: Column, na: Column, nb: Column, percent: int) -> Column:
    """Sizes and odd sketches allow the similarity."""
    bits = sum((F.bit_count(F.get(sa, k).bitwiseXOR(F.get(sb, k))) for k in range(SKETCH_WORDS)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (bits <= most_bits(percent / 100))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for shingles of ``size`` words and a similarity of ``percent`` / 100.

    Null, empty and blank texts have no shingles and link with nothing. Rows with a null doc_id link
    with nothing either: their component_id is null and they are kept. doc_id is a number. Rows of
    equal sets are one class, also where ids differ or repeat; rows that repeat an id with other
    texts are other classes, each linked only by its own set. component_id is the least doc_id of
    the linked classes. An empty table gives an empty result; other columns are ignored.

    A pair of similarity 0.8 shares none of the bands with probability 7e-6. Every pair that
    shares one is linked, or tested, or already in one component; nothing is capped.
    """
    scratch = Scratch()
    judged = _judged(docs, size, percent, scratch).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return scratch.finish(judged.select("doc_id", "n_shingles", "component_id", "kept"), "minhash-judged")


def _judged(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, set_digest, component_id, component_digest of every row.

    The last two are the least (doc_id, set_digest) that the row's set is linked with, itself included;
    digests are null where nothing links.
    """
    signed = scratch(signatures(docs, size), "minhash-signatures")
    usable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a class is a node of the link graph; its number is written with it and so stays
    nodes = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = scratch(rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "minhash-shared")
    members = scratch(join_groups(rows, shared, "bucket", "node").select("bucket", "node", "low", "high"), "minhash-buckets")
    facts = scratch(nodes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "minhash-facts")
    sets = scratch(_sets(docs, facts, size), "minhash-sets")

    def with_facts(pairs: DataFrame, pivot: str) -> DataFrame:
        other = "b" if pivot == "a" else "a"
        mine, theirs = (facts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in (pivot, other))
        met = join_partners(pairs, mine, pivot, other, scratch).join(theirs, other)
        return met.where(_likely(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), percent)).select("a", "b")

    links, tested, labels = [], [], None
    for end, pivot in (("low", "b"), ("high", "a")):
        pairs = members.select(F.greatest("node", end).alias("a"), F.least("node", end).alias("b")).where("a <> b").distinct()
        if labels is not None:
            pairs = _apart(pairs, labels, pivot, scratch).join(_all(tested), ["a", "b"], "left_anti")
        # one partner each: the others are only needed if this one fails
        hopeful = with_facts(scratch(pairs, "minhash-pairs"), pivot)
        one = hopeful.groupBy("a").agg(F.min("b").alias("b")) if end == "low" else hopeful.groupBy("b").agg(F.max("a").alias("a")).select("a", "b")
        tested.append(scratch(one, "minhash-tested"))
        links.append(scratch(_confirm(tested[-1], sets, percent, pivot, scratch), "minhash-links"))
        labels = scratch(components(_all(links), scratch=scratch), "minhash-labels")

    # what is still apart: families of documents that sketches hold for similar, then their full sets
    labelled = members.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = scratch(labelled.select("bucket", "node", "component"), "minhash-labelled")
    split = scratch(labelled.groupBy("bucket").agg(F.count("*").alias("_n"), (F.min("component") != F.max("component")).alias("apart")).where("apart OR _n > 1000"), "minhash-split")
    rest = scratch(join_groups(labelled, split, "bucket", "node").where("apart").drop("apart").join(facts.select("node", "n", "sketch"), "node"), "minhash-rest")
    families = scratch(components(_hopeful(rest, percent), scratch=scratch), "minhash-families")
    last = families.withColumnRenamed("component", "family").join(rest.select("node", "component").distinct(), "node").join(sets, "node")
    links.append(scratch(_linked(last, percent), "minhash-links"))

    least = named(_all(links), nodes, ["id", "set_digest"], scratch).select("node", F.col("id").alias("component_id"), F.col("set_digest").alias("component_digest"))
    # most classes are linked with no other: only the others are looked up
    moved = scratch(least.join(nodes.select("node", "id", "set_digest"), "node").where("component_digest <> set_digest").select("set_digest", "component_id", "component_digest"), "minhash-moved")
    own = nodes.select("set_digest", F.col("id").alias("own_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_digest")).alias("set_digest")).join(own, "set_digest", "left").join(moved, "set_digest", "left")
    return out.select("doc_id", "n_shingles", "set_digest", F.coalesce("component_id", "own_id", "doc_id").alias("component_id"), F.coalesce("component_digest", "set_digest").alias("component_digest"))


def _forest(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    """Each position that is not the first of its component, with that first one."""
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"]) if len(moved) else None


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy().view(np.uint64)
    return np.split(flat, np.cumsum(whole.value_lengths().to_numpy())[:-1])


def _hopeful(rest: DataFrame, percent: int, tile: int = 512) -> DataFrame:
    """A spanning forest (a, b) of the pairs that share a bucket, not a component, and similar sketches.

    Pairs are compared by matrices of bitmaps inside tiles of a bucket; only the forest leaves them.
    """
    most = most_bits(percent / 100)

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        ids, component, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
        if len(ids) < 2 or (component == component[0]).all():
            return None
        sketch, label = np.stack(_lists(table.column("sketch"))), np.arange(len(ids))
        for at in range(0, len(ids), 256):
            part = slice(at, at + 256)
            bits = np.bitwise_count(sketch[part, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
            sizes = np.minimum(n[part, None], n[None, :]) * 100 >= np.maximum(n[part, None], n[None, :]) * percent
            x, y = np.nonzero((bits <= most) & sizes & (component[part, None] != component[None, :]))
            merge(label, x + at, y)
        return _forest(ids, label)

    rows = in_tiles(rest, ["bucket"], "node", tile).select("bucket", "i", "j", "node", "component", "n", "sketch")
    return rows.mapInArrow(by_group(compare, 3), "a long, b long")


def _linked(rows: DataFrame, percent: int, tile: int = 256, width: int = 8192) -> DataFrame:
    """A spanning forest (a, b) of the links between components of a family, from full sets.

    Sizes of all intersections of a pair of tiles are one product of 0/1 matrices, taken over
    ``width`` shingles at a time, so memory is bounded for sets of any size.
    """

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        ids, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        if len(ids) < 2 or (component == component[0]).all():
            return None
        sets = _lists(table.column("members"))
        n = np.array([len(s) for s in sets])
        values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        # only shingles of two sets or more can be shared; they are numbered anew
        number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[code]
        owner, number = owner[number >= 0], number[number >= 0]
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        shared = np.zeros((len(sets), len(sets)))
        for at in range(0, int((times > 1).sum()), width):
            a, b = np.searchsorted(number, [at, at + width])
            block = np.zeros((len(sets), width), dtype=np.float32)
            block[owner[a:b], number[a:b] - at] = 1
            shared += block @ block.T
        x, y = np.nonzero((shared * 100 >= (n[:, None] + n[None, :] - shared) * percent) & (component[:, None] != component[None, :]))
        label = np.arange(len(ids))
        merge(label, x, y)
        return _forest(ids, label)

    tiled = in_tiles(rows, ["family"], "node", tile).select("family", "i", "j", "node", "component", "members")
    return tiled.mapInArrow(by_group(compare, 3), "a long, b long")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _apart(pairs: DataFrame, labels: DataFrame, pivot: str, scratch: Scratch) -> DataFrame:
    """The pairs whose ends are not yet in one component; ``pivot`` is the side that many pairs share."""
    other = "b" if pivot == "a" else "a"
    mine, theirs = (labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in (pivot, other))
    met = join_partners(pairs, mine, pivot, other, scratch, "left").join(theirs, other, "left")
    return met.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _with_digest(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` and the digest of each row's set, as in :func:`signatures`."""
    at = docs.columns.index("text")

    def run(batches):
        hashes = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [shingles(t or "", size, hashes) for t in batch.column(at).to_pylist()]
            return batch.append_column("_digest", pa.array([xxhash.xxh3_128_digest(v.tobytes()) if len(v) else None for v in values], pa.binary()))

        return by_batch(one)(batches)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_digest", T.BinaryType())]))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, all columns kept; rows without id or words all stay.

    The row that stays has the least doc_id of its group, and of several texts of that id the one with
    the least set digest. Where rows repeat an id, each text is judged alone, so only the copy goes and
    an unrelated text of the same id stays.

    What goes is found from ids alone, so texts are only shuffled where more ids go than may be
    broadcast. Only rows of repeated ids form their shingles again.
    """
    scratch = Scratch()
    judged = _judged(docs, size, percent, scratch).where(F.col("set_digest").isNotNull())
    judged = scratch(judged.select("doc_id", "set_digest", ((F.col("doc_id") == F.col("component_id")) & (F.col("set_digest") == F.col("component_digest"))).alias("first")), "minhash-verdicts")
    ids = judged.groupBy("doc_id").agg(F.count("*").alias("times"), F.bool_or("first").alias("any")).where("times > 1 OR NOT any")
    gone = materialize(ids.select(F.col("doc_id").alias("_id"), (F.col("times") > 1).alias("_repeated")), "minhash-gone")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = docs.join(small(gone), (F.col("doc_id") == F.col("_id")) & has_words, "left_anti")
    repeated = gone.where("_repeated").select("_id")
    if not repeated.isEmpty():
        stay = judged.where("first").select(F.col("doc_id").alias("_id"), F.col("set_digest").alias("_first")).join(repeated, "_id", "left_semi").distinct()
        stay = materialize(stay, "minhash-stay")
        again = _with_digest(docs.where(has_words).join(small(repeated), F.col("doc_id") == F.col("_id"), "left_semi"), size)
        again = again.join(stay, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_first")), "left_semi")
        left = left.unionByName(again.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))
    scratch.drop()
    return left
