"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Used only on a local master whose session names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


#: Rows and bytes that go to Python at once: a worker holds a batch of texts several times over.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: Rows of a narrow table that may be broadcast: some 30 MB. Its rows are counted first; larger ones are shuffled.
MOST_BROADCAST = 250_000


def prepare(spark: SparkSession) -> None:
    """Give the workers this package and keep the batches of texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES))


def small(rows: DataFrame) -> DataFrame:
    """A narrow table for the inner side of a join: broadcast if it has few rows, else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks it ran, and what is computed
    once is not computed again by each of several readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Writes tables on the way to a result, and deletes them once the result itself is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(materialize(df, what))
        return self.tables[-1]

    def finish(self, out: DataFrame, what: str) -> DataFrame:
        written = materialize(out, what)
        self.drop()
        return written

    def drop(self) -> None:
        for table in self.tables:
            drop_materialized(table)
        self.tables.clear()


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def pieces_of(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts have at most ``most`` bytes together; one longer text is a piece of its own."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function that applies ``fn`` to each batch that has rows, piece by piece where texts are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled training rows, chosen by a hash of the id.

    Null labels and ids are left out; of several labels of an id the largest counts, of several texts
    that whose hash is least. So there is one row an id, and at most ``limit`` rows, which bounds what is
    broadcast and what reaches the driver.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"), F.first("y").alias("y"))
    return one.select("doc_id", "least.text", "y")


def within_bytes(sample: DataFrame, most: int) -> DataFrame:
    """Rows (doc_id, text, y) in the order of a hash of the id, as long as their texts have at most ``most`` bytes together.

    The first row always stays. ``sample`` should be a written table of few rows.
    """
    sizes = sample.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if int(sizes["n"].sum()) <= most:
        return sample
    upto = max(1, int((sizes["n"].cumsum() <= most).sum()))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame([(i,) for i in sizes["doc_id"][:upto].tolist()], sample.select("doc_id").schema)), "doc_id")


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of linked positions; ``label`` holds each position's smallest one."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(below := label[label], label):
            label[:] = below


#: Groups that are listed once for each part at most; smaller groups have less than this share of all rows.
LISTED = 1024


def _parts(sizes: DataFrame, many: int) -> tuple[int, int]:
    """How many rows make a group large, and into how many parts the rows of large groups are dealt.

    A part of the largest group has about ``many`` rows, or a LISTED-th of all rows where that is more: so
    there are at most LISTED large groups and LISTED parts, whatever the sizes are.
    """
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    large = max(many, -(-(total or 0) // LISTED))
    return large, max(1, -(-(most or 0) // large))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, unit: str, many: int = 1000) -> DataFrame:
    """``rows`` with the columns of their group: ``groups`` has one row for each ``key`` and its size ``_n``.

    Large groups are listed once for each of several parts, as many as their sizes ask for, and met first, by
    key and part, so no task gets all rows of a large group; the other rows then meet their groups by key.
    ``groups`` is read several times and should be a written table.
    """
    many, parts = _parts(groups, many)
    large, values = groups.where(F.col("_n") > many), [c for c in groups.columns if c not in (key, "_n")]
    if large.isEmpty():
        return rows.join(groups.drop("_n"), key).select(*rows.columns, *values)
    spread = large.select(F.col(key).alias("_key"), *values, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(unit, F.lit("salt")), F.lit(parts)).cast("int"))
    met = salted.join(spread, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")), "left")
    rest = met.where("_key IS NULL").select(*rows.columns).join(groups.where(F.col("_n") <= many).drop("_n"), key)
    return met.where("_key IS NOT NULL").select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))


def join_partners(pairs: DataFrame, known: DataFrame, key: str, unit: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``pairs`` with what is ``known`` of their partner ``key``, which very many pairs may share; see :func:`join_groups`."""
    sizes = pairs.groupBy(key).agg(F.count("*").alias("_n"))
    return join_groups(pairs, scratch(sizes.join(known, key, how), "partners"), key, unit)


def in_tiles(rows: DataFrame, keys: list[str], unit: str, tile: int) -> DataFrame:
    """``rows`` once for each pair of tiles (i <= j) of its group that its own tile ``t`` is part of.

    Groups of ``keys`` are cut into tiles of about ``tile`` rows by a hash of ``unit``, so a group of any
    size is many tasks of bounded size, and each two of its rows meet in exactly one pair of tiles,
    or, if they share a tile, in that tile with itself. The rows come sorted by keys, i and j.

    Only groups of more than one tile have to be known, and each of these is listed once for each of
    several parts, as many as their sizes ask for, so no task gets all rows of a large group, neither to
    look it up nor to copy them. ``rows`` are counted first and should be a written table.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > tile)
    _, parts = _parts(counts, tile)
    large = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(unit, F.lit("salt")), F.lit(parts)).cast("int"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_of_{k}") for k in keys]) & (F.col("_salt") == F.col("_part"))
    tiles = F.coalesce("_tiles", F.lit(1))
    dealt = salted.join(large, same, "left").withColumns({"_tiles": tiles, "t": F.pmod(F.xxhash64(unit), tiles).cast("int")})
    copies = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumns({"i": F.least("t", "_o"), "j": F.greatest("t", "_o")})
    return copies.select(*rows.columns, "t", "i", "j").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def by_group(fn: Callable[[pa.Table], pa.RecordBatch | None], keys: int) -> Callable:
    """A mapInArrow function over rows sorted by their first ``keys`` columns: ``fn`` gets each group whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = [0, *changes.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                here = tuple(c[a] for c in columns)
                if held and here != name:
                    if (out := fn(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                name = here
                held.append(batch.slice(a, b - a))
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    return run
