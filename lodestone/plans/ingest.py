"""Ingestion: files to chunks, chunks to rows of the tables, and indexing of what is new."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunker import ChunkConfig, batches, chunks
from ..functions.text import extension
from ..operators.tables import TableStore, Transaction
from ..operators.relational import new_only
from ..session import ship_package, written

#: Fixed value: share of rows of a batch that may fail.
TOLERANCE = 0.05


def chunk_files(files: DataFrame, config: ChunkConfig = ChunkConfig(), key: str = "id", content: str = "content") -> DataFrame:
    """(key, chunk_no, content, offset, start_line, end_line) of every file's chunks.

    Null and empty contents have none.
    """
    ship_package(files.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(chunks(text or "", config)):
                    rows.append(k)
                    out.append((n, c.content, c.offset, c.start_line, c.end_line))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(c[0], pa.int32()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], names=[key, "chunk_no", "content", "offset", "start_line", "end_line"])

    return files.select(key, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, chunk_no int, content string, offset long, start_line int, end_line int")


def window_chunks(files: DataFrame, size: int, overlap: int, key: str = "id", content: str = "content") -> DataFrame:
    """Sliding windows of code points, wholly in Spark; a last window inside the overlap is dropped."""
    starts = F.sequence(F.lit(0), F.length(content) - 1, F.lit(size - overlap))
    # windows are cut before they are laid out, so a row carries its window and not the whole text
    cut = F.transform(starts, lambda at: F.struct(at.alias("start"), F.substring(F.col(content), at + 1, F.lit(size)).alias("chunk")))
    rows = files.where(F.length(content) > 0).select(key, F.explode(F.filter(cut, lambda w: (w["start"] == 0) | (F.length(w["chunk"]) > overlap))).alias("w"))
    return rows.select(key, "w.start", "w.chunk")


def chunk_tables(found: DataFrame, files: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Enrichments, locations and associations of chunks.

    ``files`` holds key, repo_id, commit_sha and path. An enrichment's id is a hash of repository,
    commit, path and chunk number, so a rerun makes the same rows. A file id of 0 has no association.
    """
    rows = found.join(files.select(key, "repo_id", "commit_sha", "path"), key).withColumn("enrichment_id", F.abs(F.xxhash64("repo_id", "commit_sha", "path", "chunk_no")))
    enrichments = rows.select(F.col("enrichment_id").alias("id"), F.lit("development").alias("type"), F.lit("chunk").alias("subtype"), "content", extension(F.col("path")).alias("language"))
    locations = rows.select("enrichment_id", F.lit(0).alias("page"), "start_line", "end_line")
    ends = F.explode(F.array(F.struct(F.lit("git_commits").alias("entity_type"), F.col("commit_sha").alias("entity_id")), F.struct(F.lit("git_commit_files").alias("entity_type"), F.col(key).cast("string").alias("entity_id")), F.struct(F.lit("git_repos").alias("entity_type"), F.col("repo_id").cast("string").alias("entity_id"))))
    associations = rows.select("enrichment_id", ends.alias("e")).select("enrichment_id", "e.entity_type", "e.entity_id").where((F.col("entity_type") != "git_commit_files") | (F.col("entity_id") != "0"))
    return {"enrichments_v2": enrichments, "source_locations": locations, "enrichment_associations": associations}


def pages_text(pages: DataFrame, key: str) -> DataFrame:
    """(key, content, boundaries): pages joined by line feeds, with the byte offset of each."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = pages.groupBy(key).agg(ordered.alias("p"))
    empty = F.array().cast("array<struct<page:int,byte_offset:bigint>>")
    fold = F.aggregate("p", F.struct(empty.alias("b"), F.lit(0).cast("long").alias("at")), lambda s, x: F.struct(F.concat(s["b"], F.array(F.struct(x["page"].cast("int").alias("page"), s["at"].alias("byte_offset")))).alias("b"), (s["at"] + F.octet_length(x["text"]) + 1).cast("long").alias("at")))
    return grouped.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("content"), fold["b"].alias("boundaries"))


def page_rows(files: DataFrame, count: str = "page_count") -> DataFrame:
    """One row with empty content for each page of each file."""
    return files.where(F.col(count) > 0).withColumn("page", F.explode(F.sequence(F.lit(1), F.col(count)))).withColumn("content", F.lit(""))


def hash_embedder(dimension: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """A stand-in model: unit vectors from hashed words."""
    from zlib import crc32

    def embed(items: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(items), dimension))
        for row, text in zip(out, items, strict=True):
            for word in text.lower().split():
                h = crc32(word.encode())
                row[h % dimension] += 1 if h & 65536 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def _attempted(model: Callable, items: list, attempts: int, pause: float) -> tuple[list | None, str | None]:
    """The model's vectors for a batch, or why there are none; pauses between attempts double."""
    error = None
    for attempt in range(attempts):
        try:
            got = model(items)
            if len(got) != len(items):
                raise ValueError(f"{len(got)} vectors for {len(items)} items")
            return [[float(x) for x in v] for v in got], None
        except Exception as e:  # noqa: BLE001  the model is the caller's
            error = f"{type(e).__name__}: {e}"
            if not getattr(e, "retryable", True):
                break
            if attempt + 1 < attempts and pause:
                time.sleep(pause * 2**attempt)
    return None, error


def embed(rows: DataFrame, model: Callable[[Sequence[str]], np.ndarray], key: str = "snippet_id", text: str = "text", most_chars: int = 16_000, most_rows: int = 64, attempts: int = 3, parallel: int = 1, pause: float = 0.0) -> DataFrame:
    """(key, embedding, error): the model over batches within a budget of characters, ``parallel`` of them at once.

    A batch that fails is tried again after a pause and then marked, so one bad batch does not fail the
    job; a model that returns another number of vectors counts as failed, and an error that says it is
    not ``retryable`` is not tried again. ``most_chars`` is also the most that the model gets of one text.
    """
    ship_package(rows.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for part in parts:
                items = [(t or "")[:most_chars] for t in part.column(1).to_pylist()]
                numbers = np.array(batches([len(t) for t in items], most_chars, most_rows), dtype=np.int64)
                groups = [np.flatnonzero(numbers == b).tolist() for b in np.unique(numbers)]
                vectors, errors = [None] * len(items), [None] * len(items)
                done = pool.map(lambda at: _attempted(model, [items[i] for i in at], attempts, pause), groups)
                for at, (got, error) in zip(groups, done, strict=True):
                    for k, i in enumerate(at):
                        vectors[i], errors[i] = None if got is None else got[k], error
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[key, "embedding", "error"])

    usable = rows.where((F.trim(F.col(text)) != "") & (F.col(key).cast("string") != ""))
    return usable.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>, error string")


def embed_items(rows: DataFrame, model: Callable[[Sequence[bytes]], np.ndarray], key: str, item: str, batch: int = 8, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, embedding, error): the model over pictures, ``batch`` at a time; a last batch that is not full counts too."""
    ship_package(rows.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                got, error = _attempted(model, some.column(1).to_pylist(), attempts, pause)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got or [None] * some.num_rows, pa.list_(pa.float64())), pa.array([error] * some.num_rows, pa.string())], names=[key, "embedding", "error"])

    return rows.where(F.col(item).isNotNull()).select(key, item).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>, error string")


def check_failures(embedded: DataFrame, tolerance: float = TOLERANCE) -> None:
    share = embedded.agg(F.avg(F.col("error").isNotNull().cast("double"))).first()[0] or 0.0
    if share > tolerance:
        raise RuntimeError(f"{share:.1%} of the rows failed")


def index_new(candidates: DataFrame, index: DataFrame, model: Callable[[Sequence[str]], np.ndarray], key: str = "snippet_id", text: str = "text", **options) -> DataFrame:
    """Vectors for the candidates that the index lacks."""
    return embed(new_only(candidates, index, key), model, key, text, **options)


def index_vectors(store: TableStore, task: str, candidates: DataFrame, model: Callable[[Sequence[str]], np.ndarray], key: str = "snippet_id", text: str = "text", tolerance: float = TOLERANCE, **options) -> int:
    """Embed what the task's vector table lacks and add it to the table; how many rows that were.

    Rows that failed are left out and come up again next time; if too large a share failed, nothing is
    stored. Vectors of another length than those stored replace the whole table, so all candidates
    are embedded anew.
    """
    name = f"vectors_{task}"
    rows = candidates.dropDuplicates([key])
    if store.exists(name):
        size = store.read(name).select(F.size("embedding")).first()
        probe = model(["dimension"])
        if size is not None and len(probe) and len(probe[0]) != size[0]:
            store.write(name, store.read(name).limit(0))
        rows = new_only(rows, store.read(name), key)
    return store_vectors(store, task, embed(rows, model, key, text, **options), key, tolerance)


def store_vectors(store: TableStore, task: str, embedded: DataFrame, key: str = "snippet_id", tolerance: float = TOLERANCE) -> int:
    """Add embedded rows to a task's vector table, unless too large a share of them failed; how many.

    Of writers at once each adds what the others have not, so no row is lost and none is there twice.
    """
    fresh, name = written(embedded, "vectors"), f"vectors_{task}"
    check_failures(fresh, tolerance)
    good = fresh.where("error IS NULL").select(key, "embedding")

    def change(tx: Transaction) -> int:
        there = tx.exists(name)
        rows = new_only(good, tx.read(name), key) if there else good
        count = rows.count()
        if count or not there:
            tx.append(name, rows)
        return count

    return store.update(change)


def generate(requests: DataFrame, model: Callable[[str, str], str], key: str = "id", system: str = "system", text: str = "text", parallel: int = 1) -> DataFrame:
    """(key, answer, error) of a text generator over requests, ``parallel`` of a task at once.

    Answers keep the order of the requests; failed ones keep their place without an answer.
    """
    ship_package(requests.sparkSession)

    def ask(request: tuple[str, str]) -> tuple[str | None, str | None]:
        try:
            return model(request[0] or "", request[1] or ""), None
        except Exception as e:  # noqa: BLE001  the model is the caller's
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for part in parts:
                answers = list(pool.map(ask, zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in answers], pa.string()), pa.array([e for _, e in answers], pa.string())], names=[key, "answer", "error"])

    return requests.select(key, system, text).mapInArrow(run, f"{key} {dict(requests.dtypes)[key]}, answer string, error string")
