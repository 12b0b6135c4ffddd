"""The stored keyword index: postings by term and block, kept up to date and read by the terms of a query.

Postings are partitioned by a hash of the term and sorted by term and block inside, so a query reads the
partitions of its terms and in them the pages that can hold these. A block is a share of the documents,
alike in length, and the same for all terms. A row holds what a block has of a term: all postings, packed
by the task that read the documents, how many they are and how much they can score at most. So texts and
single postings are never shuffled, rows are, once. A bag of words is answered by the blocks that promise most:
what they score is a bound, and only blocks that can reach it are read besides. Document frequencies and
lengths are those of the whole index, whatever a search is restricted to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import options as O
from ..operators.relational import new_only
from ..operators.tables import TableStore, Transaction
from ..session import discard, shared_path, ship_package, source_digest, written
from . import retrieval

_POSTINGS = "term string, block int, n long, impact float, ids array<string>, dls array<int>, tfs array<int>, places array<int>, slot int"
_CONFIG = "slots int, spread int, built long, mean double"
#: Documents that a block is meant for, terms that a slot is meant for, and how far a corpus may outgrow its layout.
BLOCK_DOCS, SLOT_TERMS, OUTGROWN = 32, 1_000_000, 4
#: Classes of length a corpus is taken to have, rows of a page, blocks read for a first bound, ranges of blocks in a filter.
CLASSES, PAGE_ROWS, FIRST_BLOCKS, MOST_RANGES = 8, 512, 12, 400
#: Terms that a task packs at once, and numbers of blocks in a class of length at most.
PACKED_TERMS, MOST_NUMBERS = 4_000_000, 1 << 25
#: Slots whose rows travel together as one Parquet value, parcels at least, and how many times the average a part of one may hold.
PARCEL_SLOTS, LEAST_PARCELS, LARGE_PARCEL = 2, 8, 4
#: Steps of one in which impacts are rounded up, so that a byte holds one.
IMPACT_STEPS = 64


def layout(n: int, total: int) -> tuple[int, int]:
    """Slots and parts of a class of length, for so many documents and terms; both grow with the corpus."""
    slots = 1 << max(3, (total // SLOT_TERMS).bit_length())
    return slots, max(1, n // (BLOCK_DOCS * CLASSES))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def slot_of(term: str, slots: int) -> int:
    """A term's slot, by Spark's xxhash64."""
    return ((xxhash.xxh64_intdigest(term.encode(), 42) ^ 1 << 63) - (1 << 63)) % slots


class KeywordIndex:
    """Postings of (id, text) rows under one analyzer: words, porter or bag (see ``retrieval.ANALYZERS``)."""

    def __init__(self, spark: SparkSession, folder: str, analyzer: str = "porter", slots: int | None = None) -> None:
        """Open an index; ``slots`` fixes the partitions of a new one, which else follow from the corpus."""
        self.store, self.analyzer, self.wanted = TableStore(spark, folder, PAGE_ROWS, "zstd"), analyzer, slots
        self._known: tuple[int, Any] = (-1, None)

    @property
    def exists(self) -> bool:
        return self.store.exists("postings")

    @property
    def slots(self) -> int | None:
        return self._config(self.store.begin())["slots"] if self.exists else self.wanted

    def _config(self, tx: Transaction) -> Any:
        """The layout at a transaction's start, read once for each commit that is looked at."""
        tx.reads.add("config")
        if self._known[0] != tx.base["number"]:
            self._known = (tx.base["number"], tx.read("config", _CONFIG).first())
        return self._known[1]

    @staticmethod
    def _repeated(docs: DataFrame) -> bool:
        """Whether an id occurs twice: only ids are looked at and shuffled."""
        return not docs.groupBy(F.col("id").cast("string")).count().where("count > 1").isEmpty()

    @staticmethod
    def usable(docs: DataFrame, repeated: bool = True) -> DataFrame:
        """Rows with an id and a text that is not blank, each id once."""
        rows = docs.select(F.col("id").cast("string").alias("id"), "text")
        rows = rows.where((F.trim("text") != "") & (F.col("id") != ""))
        return rows.dropDuplicates(["id"]) if repeated else rows

    @staticmethod
    def _laid(rows: DataFrame) -> DataFrame:
        # a partition is one file where it is small, and a frequent term's postings are many files
        return rows.select(*_names(_POSTINGS)).hint("rebalance", "slot").sortWithinPartitions("slot", "term", "block")

    @staticmethod
    def _packed(analysed: DataFrame, slots: int, spread: int, mean: float) -> DataFrame:
        """What each block has of each term, of documents (id, terms); blocks are cut from the documents of a task, by length."""
        ship_package(analysed.sparkSession)
        most, numbers, parcels = BLOCK_DOCS, min(spread * CLASSES, MOST_NUMBERS), max(min(slots, LEAST_PARCELS), slots // PARCEL_SLOTS)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in packed(batch, most, numbers, mean, slots):
                    yield from parcels_of(rows, parcels)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in batch.column(2):
                    yield from pq.read_table(pa.BufferReader(some.as_buffer())).to_batches()

        # parts of a parcel that a frequent term makes large go to other partitions
        sent = analysed.select("id", "terms").mapInArrow(pack, "parcel int, part int, rows binary").repartition(4 * parcels, "parcel", "part")
        return sent.mapInArrow(unpack, _POSTINGS).sortWithinPartitions("slot", "term", "block")

    @staticmethod
    def unpacked(rows: DataFrame) -> DataFrame:
        """(term, id, dl, tf, positions, block, slot) of packed rows, and what other columns they have."""
        own = _names(_POSTINGS)
        at, tf = F.col("_at"), F.element_at("tfs", F.col("_at"))
        first = F.aggregate(F.slice("tfs", F.lit(1), at - 1), F.lit(1), lambda a, x: a + x)
        single = [F.element_at("ids", at).alias("id"), F.element_at("dls", at).alias("dl"), tf.cast("long").alias("tf"), F.slice("places", first, tf).alias("positions")]
        return rows.select("*", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("_at")).select("term", *single, "block", "slot", *[c for c in rows.columns if c not in own])

    @staticmethod
    def _repacked(postings: DataFrame, mean: float) -> DataFrame:
        """Packed rows of postings that have their slot and block."""
        most = (F.ceil(F.max(retrieval.impact(F.col("tf"), F.col("dl"), F.lit(mean))) * IMPACT_STEPS) / IMPACT_STEPS).cast("float").alias("impact")
        rows = postings.groupBy("slot", "term", "block").agg(F.count("*").alias("n"), most, F.sort_array(F.collect_list(F.struct("id", "dl", F.col("tf").cast("int").alias("tf"), "positions"))).alias("p"))
        return rows.select("term", "block", "n", "impact", F.col("p.id").alias("ids"), F.col("p.dl").alias("dls"), F.col("p.tf").alias("tfs"), F.flatten("p.positions").alias("places"), "slot")

    def _placed(self, rows: DataFrame, slots: int, spread: int) -> DataFrame:
        """Postings with their slot, by the term, and block, by the document's length and id."""
        kind = F.floor(2 * F.log2(F.col("dl") + 1)).cast("int")
        block = kind * min(spread * CLASSES, MOST_NUMBERS) + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
        return rows.withColumns({"slot": F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"), "block": block})

    def _put_docs(self, tx: Transaction, analysed: DataFrame, replace: bool) -> Any:
        """Write the documents' lengths and their sums; (documents, terms) of these."""
        put = tx.replace if replace else tx.append
        put("docs", analysed.select("id", F.size("terms").alias("dl")))
        lengths = tx.staged("docs", "id string, dl int")
        put("stats", lengths.agg(F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")))
        return lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()

    def _terms(self, rows: DataFrame) -> DataFrame:
        return retrieval._terms(rows, "id", "text", self.analyzer)

    def build(self, docs: DataFrame) -> KeywordIndex:
        """Replace the index by one of these rows (id, text).

        Texts that Spark's own functions split are read twice; what Python makes of them, or a choice among
        texts of one id, is written in between.
        """
        kept = (repeated := self._repeated(docs)) or self.analyzer != "words"
        analysed = self._terms(self.usable(docs, repeated))
        if kept:
            analysed = written(analysed, "terms", "zstd")

        def change(tx: Transaction) -> None:
            n, total = self._put_docs(tx, analysed, True)
            slots, spread = layout(n, total)
            slots, mean = self.wanted or slots, max(float(total), 1.0) / max(n, 1)
            tx.replace("config", docs.sparkSession.createDataFrame([(slots, spread, n, mean)], _CONFIG))
            tx.replace("postings", self._packed(analysed, slots, spread, mean), ["slot"])

        self.store.update(change)
        if kept:
            discard(analysed)
        return self

    def add(self, docs: DataFrame) -> int:
        """Index the rows (id, text) that are new; how many there were. Of writers at once each adds what the others have not.

        An index that has outgrown its layout is laid out anew, from its postings, not from texts.
        """
        if not self.exists:
            self.build(docs)
            return self.store.read("docs").count()
        rows = self.usable(docs)

        def change(tx: Transaction) -> int:
            config, known = self._config(tx), tx.read("docs", "id string, dl int")
            analysed = written(self._terms(new_only(rows, known, "id")), "terms", "zstd")
            if count := analysed.count():
                self._put_docs(tx, analysed, False)
                tx.append("postings", self._packed(analysed, config["slots"], config["spread"], config["mean"]), ["slot"])
            discard(analysed)
            return count

        count = self.store.update(change)
        self.grow()
        return count

    def grow(self) -> bool:
        """Lay the postings out anew if there are OUTGROWN times as many documents as they were laid out for."""

        def change(tx: Transaction) -> bool:
            config = self._config(tx)
            n, total = tx.read("stats", "n long, total long").agg(F.sum("n"), F.sum("total")).first()
            if (n or 0) <= OUTGROWN * max(config["built"], 1):
                return False
            slots, spread = layout(n, total)
            slots, mean = max(slots, config["slots"]), max(float(total), 1.0) / n
            tx.replace("config", self.store.spark.createDataFrame([(slots, spread, n, mean)], _CONFIG))
            rows = self._placed(tx.read("postings", _POSTINGS, self.unpacked).drop("slot", "block"), slots, spread)
            tx.replace("postings", self._laid(self._repacked(rows, mean)), ["slot"])
            return True

        return self.store.update(change)

    def remove(self, ids: DataFrame) -> None:
        """Delete these ids: their keys are written, and postings stay until :meth:`compact`."""
        gone = ids.select(F.col("id").cast("string").alias("id")).distinct()

        def change(tx: Transaction) -> None:
            known = tx.read("docs", "id string, dl int").join(gone, "id", "left_semi")
            less = known.agg((-F.count_if(F.col("dl") > 0)).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("total"))
            tx.append("stats", less)
            tx.delete("docs", gone)
            tx.delete("postings", gone)

        self.store.update(change)

    def compact(self) -> int:
        """Rewrite the files that hold postings of deleted ids; how many files these were."""
        self.store.compact("docs")
        mean = self._config(self.store.begin())["mean"]
        return self.store.compact("postings", lambda rows: self._laid(self._repacked(rows, mean)), self.unpacked)

    def count(self) -> int:
        return self.store.read("docs", "id string, dl int").count() if self.exists else 0

    def has(self, key: str) -> bool:
        return self.exists and not self.lookup([key]).isEmpty()

    def _of(self, tx: Transaction, terms: Sequence[str], packed: bool = False) -> DataFrame:
        """The postings of some terms: a filter on partitions and on terms. Packed rows hold deleted postings too."""
        slots = self._config(tx)["slots"]
        rows = tx.read("postings", _POSTINGS, None if packed else self.unpacked, packed)
        return rows.where(F.col("slot").isin(sorted({slot_of(t, slots) for t in terms})) & F.col("term").isin(list(terms)))

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, id, dl, tf, positions) of the terms."""
        return self._of(self.store.begin(), list(dict.fromkeys(terms))).select("term", "id", "dl", "tf", "positions")

    def stats(self) -> DataFrame:
        """One row: n, the number of documents with terms, and mean, their average length."""
        return self.store.read("stats", "n long, total long").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))

    def find(self, query: str, k: int = retrieval.TOP, allowed: DataFrame | None = None, phrase: bool = True) -> DataFrame:
        """(id, score) of the best documents for a phrase, or for a bag of words; ``allowed`` (id) restricts, also if empty."""
        terms = retrieval.ANALYZERS[self.analyzer](query)
        if not phrase:
            return self.best(terms, k, allowed)
        return retrieval.bm25_phrase(self._sharing(terms), terms, k, "id", stats=self.stats(), allowed=allowed)

    def _sharing(self, terms: list[str]) -> DataFrame:
        """The postings of the terms in the blocks that have all of them."""
        tx, wanted = self.store.begin(), list(dict.fromkeys(terms))
        hits = self._of(tx, wanted)
        if len(wanted) > 1:
            blocks = self._of(tx, wanted, True).groupBy("block").agg(F.countDistinct("term").alias("terms"))
            hits = hits.join(blocks.where(F.col("terms") == len(wanted)), "block", "left_semi")
        return hits

    def best(self, terms: Sequence[str], k: int = retrieval.TOP, allowed: DataFrame | None = None) -> DataFrame:
        """The best documents for a bag of terms, the same as ``retrieval.bm25_terms`` finds, from few blocks.

        While deleted postings are still in the files, all postings of the terms are read, since only they
        tell how many documents a term is left in.
        """
        tx, wanted, k = self.store.begin(), list(dict.fromkeys(terms)), retrieval._top(k)
        hits = self._of(tx, wanted)
        if not wanted or tx.base["tables"]["postings"]["gone"]:
            return retrieval.bm25_terms(hits, wanted, k, stats=self.stats(), allowed=allowed)
        blocks = self._of(tx, wanted, True).select("term", "block", "n", "impact")
        # one row a term, and one of the corpus
        sums = blocks.groupBy("term").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("total"))
        sums = sums.unionByName(tx.read("stats", "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("term", F.lit(None).cast("string")))
        known = {r["term"]: r for r in sums.collect()}
        n, mean = known[None]["n"] or 0, (known[None]["total"] or 0) / max(known[None]["n"] or 0, 1)
        often = {t: known[t]["n"] for t in wanted if t in known}
        if not often:
            return hits.select("id", F.lit(0.0).alias("score")).limit(0)
        scored = lambda rows: retrieval._allowed(retrieval.bm25_known(rows, often, n, mean), "id", allowed)
        # of a term's rows in a block the best one; an impact grows with the mean length, and no faster;
        # rounded up, so that no rounding leaves a block out
        each = [retrieval.idf(F.lit(often[t]), F.lit(n)) * F.coalesce(F.max(F.when(F.col("term") == t, F.col("impact"))).cast("double"), F.lit(0.0)) for t in often]
        most = reduce(lambda a, b: a + b, each) * (max(1.0, mean / self._config(tx)["mean"]) * (1 + 1e-9))
        promise = blocks.groupBy("block").agg(most.alias("most"))
        # of one term, the k best are in the k blocks that promise most
        first = promise.orderBy(F.desc("most"), "block").limit(max(FIRST_BLOCKS, k)).collect()
        got = scored(hits.where(in_blocks([r["block"] for r in first]))).orderBy(F.desc("score"), "id").limit(k).collect()
        if len(first) < FIRST_BLOCKS:
            bound = None
        else:
            bound = got[-1]["score"] if len(got) == k else 0.0
        able = promise if bound is None else promise.where(F.col("most") >= bound)
        few = able.select("block").limit(MOST_RANGES + 1).collect()
        chosen = hits.where(in_blocks([r["block"] for r in few])) if len(few) <= MOST_RANGES else hits.join(able, "block", "left_semi")
        return scored(chosen).orderBy(F.desc("score"), "id").limit(k)

    def lookup(self, ids: Sequence[str]) -> DataFrame:
        """Which of these ids are indexed, with score 0: what a search without a query finds."""
        rows = self.store.read("docs", "id string, dl int")
        return rows.where(F.col("id").isin([str(i) for i in ids])).select("id", F.lit(0.0).alias("score"))


def packed(batch: pa.RecordBatch, most: int, numbers: int, mean: float, slots: int) -> Iterator[pa.RecordBatch]:
    """The packed rows of documents (id, terms), in blocks of at most so many documents alike in length."""
    import numpy as np

    all_offsets = batch.column(1).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        # as many documents as have PACKED_TERMS, but one at least
        end = max(at + 1, int(np.searchsorted(all_offsets, all_offsets[at] + PACKED_TERMS, "right")) - 1)
        offsets, ids = all_offsets[at : end + 1].astype(np.int64), batch.column(0).slice(at, end - at)
        terms = batch.column(1).values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        at, offsets = end, offsets - offsets[0]
        if not len(terms):
            continue
        dl = np.diff(offsets)
        kind = np.floor(2 * np.log2(dl + 1)).astype(np.int64)
        order = np.argsort(dl, kind="stable")
        # a block begins with a class of length, and after so many documents of it
        starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        begins = place % most == 0
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(begins) - 1
        heads = order[begins]
        block = np.array([kind[d] * numbers + xxhash.xxh64_intdigest(ids[int(d)].as_py().encode()) % numbers for d in heads], np.int32)
        # the terms by term and block, and in these as the documents have them
        doc, code = np.repeat(np.arange(len(dl)), dl), terms.indices.to_numpy().astype(np.int64)
        key = code * len(heads) + run[doc]
        sort = np.argsort(key, kind="stable")
        key, doc, code, position = key[sort], doc[sort], code[sort], (np.arange(len(sort)) - offsets[doc])[sort]
        first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        tf, of = np.diff(np.append(first, len(key))), doc[first]
        rows = np.flatnonzero(np.diff(key[first], prepend=-1))
        n = np.diff(np.append(rows, len(first)))
        best = np.maximum.reduceat(retrieval.impact(tf, dl[of], mean), rows)
        slot = np.array([slot_of(t, slots) for t in terms.dictionary.to_pylist()], np.int32)
        lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        postings, places = np.append(rows, len(first)), np.append(first[rows], len(key))
        columns = [
            terms.dictionary.take(pa.array(code[first[rows]])), pa.array(block[run[of[rows]]]), pa.array(n), pa.array((np.ceil(best * IMPACT_STEPS) / IMPACT_STEPS).astype(np.float32)), lists(postings, ids.take(pa.array(of))),
            lists(postings, pa.array(dl[of].astype(np.int32))), lists(postings, pa.array(tf.astype(np.int32))), lists(places, pa.array(position.astype(np.int32))),
            pa.array(slot[code[first[rows]]]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_names(_POSTINGS))


def parcels_of(rows: pa.RecordBatch, parcels: int) -> Iterator[pa.RecordBatch]:
    """The rows of each parcel of slots, (parcel, part, rows): as Parquet, in parts of a bounded number of rows."""
    import numpy as np

    number, large = rows.column(rows.num_columns - 1).to_numpy() % parcels, max(1, LARGE_PARCEL * rows.num_rows // parcels)
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(parcels + 1))
    for parcel in np.flatnonzero(np.diff(ends)):
        for part, at in enumerate(range(ends[parcel], ends[parcel + 1], large)):
            out = pa.BufferOutputStream()
            some = rows.take(pa.array(order[at : min(at + large, ends[parcel + 1])]))
            pq.write_table(pa.Table.from_batches([some]), out, compression="zstd", write_statistics=False, store_schema=False)
            yield pa.RecordBatch.from_arrays([pa.array([parcel], pa.int32()), pa.array([part], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["parcel", "part", "rows"])


def in_blocks(blocks: Sequence[int]) -> Column:
    """A block is one of these: ranges, each of which a file's page statistics can rule out."""
    ranges: list[list[int]] = []
    for b in sorted(blocks):
        if ranges and b == ranges[-1][1] + 1:
            ranges[-1][1] = b
        else:
            ranges.append([b, b])
    return reduce(lambda x, r: x | F.col("block").between(*r), ranges, F.lit(False))


def find(index: KeywordIndex, q: O.Query) -> DataFrame:
    """(id, score) of what a query's options ask an index: its text and allow-list, else the ids of its conditions with score 0."""
    if not q.params.get("query"):
        rows = q.apply_conditions(index.store.read("docs", "id string, dl int").withColumn("snippet_id", F.col("id")))
        rows = rows if "allowed" not in q.params else rows.join(q.params["allowed"].select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        return rows.select("id", F.lit(0.0).alias("score"))
    found = index.find(q.params["query"], retrieval._top(q.count) + q.skip, q.params.get("allowed"), phrase=q.params.get("phrase", True))
    return found.orderBy(F.desc("score"), "id").offset(q.skip) if q.skip else found


def find_vectors(vectors: DataFrame, q: O.Query, key: str = "id") -> DataFrame:
    """(key, score) of what a query's options ask a vector table: its embedding under its conditions and allow-list."""
    rows = q.apply_conditions(vectors)
    if "embedding" not in q.params:
        return rows.select(key, F.lit(0.0).alias("score"))
    return retrieval.exact_topk(rows, q.params["embedding"], retrieval._top(q.count), key, allowed=q.params.get("allowed"), least=q.params.get("least"), skip=q.skip)


def shared_index(documents: DataFrame, key: str, text: str, analyzer: str, slots: int | None = None, rebuild: bool = False) -> KeywordIndex:
    """The index of a table that is stored in files, in the shared folder; built once for the files as they are."""
    made_by = source_digest(__name__, *(f"lodestone.{m}" for m in ("plans.retrieval", "functions.stemming", "functions.porter2")))
    where = shared_path(documents, f"keywords {made_by} {key} {text} {analyzer} {slots}")
    index = KeywordIndex(documents.sparkSession, where, analyzer, slots)
    if rebuild or not index.exists:
        index.build(documents.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")))
    return index
